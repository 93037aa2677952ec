"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about `FRAME_BYTES`; a bundle of frames ends with a seek table
in a skippable frame (the public seekable format: compressed size, size and checksum of each frame), so any Zstandard
reader can unpack it. `write` returns the index: where each record identifier lies (bundle, frame, offset in the frame,
length). `read` walks whole bundles, `fetch` reads one record by its index row without touching other frames.

Of pages with equal payloads of at least `least` bytes the one with the smallest page_id is a response and the others
are revisits that refer to it. Rows that repeat that page_id and payload are responses too; a null page_id is never
the smallest unless all are null. Null html is an empty payload; a null url has no target header. The html of a page
travels once, by its digest; of large groups of copies Spark splits the join.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actiontrail.llm.shared import attempt_name, filesystem, get, put, saved, scratch, ship, spread_count

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 32 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, page_id long, path string, frame int, offset long, length long"
ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html and the page that a revisit refers to."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    first = (rows.where(F.octet_length("html") >= least).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    return (rows.join(first.select("digest", "first"), "digest", "left")
            .withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
            .select("page_id", "url", "html", "refers_to"))


def record_name(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str | None, html: str, refers_to: int | None) -> tuple[str, bytes]:
    payload = html.encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = record_name(page_id, digest)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(refers_to, digest)}"]
    head.append(f"Content-Length: {len(block)}")
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at `at`, and where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at byte {at}")
    head = dict(x.split(": ", 1) for x in lines[1:])
    begin, size = end + 4, int(head["Content-Length"])
    return head, data[begin:begin + size], begin + size + 4


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    body = b"".join(struct.pack("<III", *f) for f in frames) + struct.pack("<IBI", len(frames), 0x80, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(uri: str) -> list[tuple[int, int, int, int]]:
    """(place, compressed size, size, checksum) of each frame, from the end of the bundle."""
    system, path = filesystem(uri)
    total = system.get_file_info(path).size
    many, flags, magic = struct.unpack("<IBI", get(uri, total - 9))
    if magic != SEEKABLE or flags != 0x80:
        raise ValueError(f"no seek table in {uri}")
    table, out, place = get(uri, total - 9 - 12 * many, 12 * many), [], 0
    for own, size, check in struct.iter_unpack("<III", table):
        out.append((place, own, size, check))
        place += own
    return out


def unpacked(uri: str, frame: tuple[int, int, int, int]) -> bytes:
    import xxhash
    import zstandard

    place, own, size, check = frame
    data = zstandard.ZstdDecompressor().decompress(get(uri, place, own), max_output_size=max(size, 1))
    if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
        raise ValueError(f"damaged frame at byte {place} of {uri}")
    return data


def write(pages: DataFrame, least: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes the bundles; returns the index (saved): one row per record."""
    spark = pages.sparkSession
    ship(spark)
    folder = scratch(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        state: dict = {}

        def fresh() -> None:
            info = b"software: actiontrail\r\nformat: WARC File Format 1.1\r\n"
            head = (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\n"
                    f"Content-Length: {len(info)}\r\n\r\n").encode()
            state.update(path=f"{folder}/{attempt_name()}.warc.zst", out=[], frames=[], size=0, frame=[head + info + b"\r\n\r\n"],
                         filled=len(head) + len(info) + 4, index=[])

        def end_frame() -> None:
            data = b"".join(state["frame"])
            own = pack.compress(data)
            state["out"].append(own)
            state["frames"].append((len(own), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            state["size"] += len(own)
            state["frame"], state["filled"] = [], 0

        def end_bundle() -> pa.RecordBatch:
            if state["frame"]:
                end_frame()
            put(state["path"], b"".join([*state["out"], seek_table(state["frames"])]))
            name, page, frame, offset, length = zip(*state["index"])
            out = pa.RecordBatch.from_arrays(
                [pa.array(name), pa.array(page, pa.int64()), pa.array([state["path"]] * len(name)), pa.array(frame, pa.int32()),
                 pa.array(offset, pa.int64()), pa.array(length, pa.int64())],
                names=["record_id", "page_id", "path", "frame", "offset", "length"])
            fresh()
            return out

        fresh()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    name, data = record(row["page_id"], row["url"], row["html"], row["refers_to"])
                    state["index"].append((name, row["page_id"], len(state["frames"]), state["filled"], len(data)))
                    state["frame"].append(data)
                    state["filled"] += len(data)
                    if state["filled"] >= frame_bytes:
                        end_frame()
                        if state["size"] >= bundle_bytes:
                            yield end_bundle()
        if state["index"]:
            yield end_bundle()

    return saved(roles(pages, least).mapInArrow(run, INDEX), "warc-index")


def _row(head: dict[str, str], block: bytes) -> tuple:
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = head["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not fit its digest")

    def page(name: str) -> int | None:
        own = name.split(":")[2]
        return None if own == "null" else int(own)

    refers = head.get("WARC-Refers-To")
    return (page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, digest, kind,
            None if refers is None else page(refers), payload if kind == "response" else None)


def read(index: DataFrame) -> DataFrame:
    """All records of the bundles that the index names, with their digests checked."""
    ship(index.sparkSession)
    names = [x.split()[0] for x in ROWS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                for frame in frames_of(uri):
                    data, at, rows = unpacked(uri, frame), 0, []
                    while at < len(data):
                        head, block, at = parse(data, at)
                        if head["WARC-Type"] != "warcinfo":
                            rows.append(_row(head, block))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    # Paths are few and short, but each stands for a bundle: dealt round by round to a fixed number of tasks, not put together by their size.
    bundles = index.select("path").distinct().repartition(spread_count(index))
    return bundles.mapInArrow(run, ROWS)


def fetch(path: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record through the seek table and its index row."""
    data = unpacked(path, frames_of(path)[frame])
    head, block, end = parse(data, offset)
    if end - offset != length:
        raise ValueError("the index does not fit the bundle")
    return head, block


def archive_report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from the archives."""
    return read(write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
