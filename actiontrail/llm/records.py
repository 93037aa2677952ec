"""Token ids as length-delimited binary records with a separate offset index.

A record file holds, for each document, an unsigned 64-bit length, its masked CRC-32C, the payload and the
payload's masked CRC-32C (the framing that readers of TFRecord files know). The payload is the document's id
(signed 64-bit), a flag byte (1: the id is null), a width byte (2 or 4), two zero bytes, the number of ids (unsigned
32-bit) and the ids, little-endian and unsigned, in the smallest width that holds them all. Beside `x.rec` lies `x.idx`: (offset, payload length) as two unsigned 64-bit numbers
for each record, so a reader can fetch records in any order without reading the file through.

`write` deals texts by ranges of doc_id, so file order is doc_id order (nulls first; equal ids by text). Each task
encodes its sorted range, writes files of bounded size under names no other attempt has, and returns a manifest row per
file; only files in the committed manifest count, so lost executors leave orphans and no damage. Null and empty texts
give a record with the end id only. Extra columns are ignored; repeated rows give repeated records.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from actiontrail.llm.crc import crc32c, masked
from actiontrail.llm.shared import attempt_name, get, put, saved, scratch, ship, spread_count
from actiontrail.llm.tokens import default_tokenizer, encoder

END_ID = 2
FILE_BYTES = 32 << 20
HEAD, HEAD_BYTES = "<QI", 12
FRONT, FRONT_BYTES = "<qBB2xI", 16
MANIFEST = "part int, file int, path string, n_docs long, n_tokens long, n_bytes long"


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(crc32c(size))), payload, struct.pack("<I", masked(crc32c(payload)))))


def unframe(data: bytes, at: int) -> tuple[memoryview, int]:
    """The payload at `at` and where the next record begins; raises where a checksum is wrong."""
    size, check = struct.unpack_from(HEAD, data, at)
    begin = at + HEAD_BYTES
    payload = memoryview(data)[begin:begin + size]
    if masked(crc32c(data[at:at + 8])) != check or len(payload) != size or \
            masked(crc32c(payload)) != struct.unpack_from("<I", data, begin + size)[0]:
        raise ValueError(f"damaged record at byte {at}")
    return payload, begin + size + 4


def payload_of(doc: int | None, raw: bytes) -> bytes:
    """From little-endian unsigned 32-bit ids."""
    ids = np.frombuffer(raw, "<u4")
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return struct.pack(FRONT, doc or 0, doc is None, width, len(ids)) + ids.astype(f"<u{width}").tobytes()


def ids_of(payload: memoryview) -> tuple[int | None, np.ndarray]:
    """The document's id and its ids, unsigned 32-bit."""
    doc, null, width, n = struct.unpack_from(FRONT, payload)
    ids = np.frombuffer(payload[FRONT_BYTES:], f"<u{width}").astype("<u4")
    if len(ids) != n:
        raise ValueError("a record's ids do not fit their number")
    return None if null else doc, ids


def write(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes record and index files; returns their manifest (saved, one row per file)."""
    spark = docs.sparkSession
    ship(spark)
    path, folder, end = tokenizer or default_tokenizer(), scratch(spark, "records"), end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, number = encoder(path), TaskContext.get().partitionId(), 0
        data, index, tokens, size = [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"{folder}/{attempt_name()}-{number:05d}"
            put(f"{name}.rec", b"".join(data))
            put(f"{name}.idx", np.asarray(index, "<u8").tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([name]), pa.array([len(data)], pa.int64()),
                 pa.array([tokens], pa.int64()), pa.array([size], pa.int64())],
                names=["part", "file", "path", "n_docs", "n_tokens", "n_bytes"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                own = batch.slice(at, 500)
                for doc, raw in zip(own.column(0).to_pylist(), coder.encode(own.column(1).to_pylist())):
                    raw += end
                    record = frame(payload_of(doc, raw))
                    data.append(record)
                    index.append((size, len(record) - 16))
                    tokens, size = tokens + len(raw) // 4, size + len(record)
                    if size >= file_bytes:
                        yield close()
                        data, index, tokens, size, number = [], [], 0, 0, number + 1
        if data:
            yield close()

    placed = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
              .repartitionByRange(spread_count(docs), F.col("doc_id").asc_nulls_first())
              .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text"))
    return saved(placed.mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Every record of the files, checked: doc_id, part, file, place in the file, ids before it in all files, ids."""
    ship(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, at, place, before = get(f"{row['path']}.rec"), 0, 0, row["base"]
                while at < len(data):
                    ids, docs, befores, first, size = [], [], [], place, 0
                    while at < len(data) and size < 4 << 20:
                        payload, at = unframe(data, at)
                        doc, own = ids_of(payload)
                        docs.append(doc)
                        befores.append(before)
                        ids.append(own.tobytes())
                        before, place, size = before + len(own), place + 1, size + len(payload)
                    many = len(docs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs, pa.int64()), pa.array([row["part"]] * many, pa.int32()),
                         pa.array([row["file"]] * many, pa.int32()), pa.array(range(first, place), pa.int64()),
                         pa.array(befores, pa.int64()), pa.array(ids, pa.binary())],
                        names=["doc_id", "part", "file", "place", "before", "ids"])

    # Where a file's ids begin is known from the manifest, so the documents' rows meet no other table.
    files = positions(manifest).repartition(spread_count(manifest), "path")
    return files.mapInArrow(run, "doc_id long, part int, file int, place long, before long, ids binary")


def fetch(path: str, places: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of one file in any order, by its index: what a shuffling reader calls."""
    index = np.frombuffer(get(f"{path}.idx"), "<u8").reshape(-1, 2)
    out = []
    for place in places:
        start, size = (int(x) for x in index[place])
        payload, _ = unframe(get(f"{path}.rec", start, size + 16), 0)
        out.append(ids_of(payload))
    return out


def positions(manifest: DataFrame) -> DataFrame:
    """Ids before each file, in file order: a window over one row per file."""
    earlier = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select("part", "file", "path", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("base"))


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all from the files as they are read back."""
    rows = read(write(docs, tokenizer))
    return rows.select("doc_id", F.col("before").alias("start"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))
