"""Exact substring deduplication by a distributed merge sort of suffixes that knows common prefixes.

A byte goes if a string of `LENGTH` bytes that covers it also starts earlier: in a smaller document (doc_id, then text
hash; null ids first), or earlier in the same one.

1. Sparse suffixes. Of the half-length strings ("grams") in each window of `LENGTH` bytes the one with the smallest hash is an
   anchor, so equal windows have equal anchors at equal offsets, and every window has one. Only suffixes
   from anchors are sorted: with `LEFT` bytes before them they tell about all windows around them.
2. Duplicate detection. Anchors' gram hashes are exchanged in compact blocks; suffixes whose gram occurs once cannot
   be duplicates and are left out, so only suffixes with a chance travel.
3. Runs. Each task sorts the suffixes of its texts, keeps the earliest of equal ones, and sends them as front-coded runs: for
   each suffix the length that it shares with the one before it, and the bytes behind that.
4. Merge. A bucket's runs are merged by a loser tree that carries common-prefix lengths: a comparison starts behind
   what both are known to share. The merged order's common-prefix lengths give the classes of equal strings at every
   depth; with the same for the bytes to the left, all windows of an anchor are judged against earlier ones.
   Grams that occur more than `HEAVY` times go window by window instead, dealt by the window's own hash, so no bucket
   grows with a group of copies.
5. The spans come back to their texts and are merged.

Later rows with a text that occurred before go as a whole (if it has `LENGTH` bytes); they take no part in the sorting, as
the first has all that they have. Null text counts as empty. Other columns are kept by `dedup`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from actiontrail.llm.groups import runs_of
from actiontrail.llm.shared import aside, saved, ship, spread_count
from actiontrail.llm.text_bytes import MIX1, MIX2, mixed, parts, powers, prefix_hash, texts

LENGTH = 100
GRAM = 50
LEFT = LENGTH - GRAM
HEAVY = 50_000
NO_ID = -(1 << 63)
HEAVY_BIT = np.uint32(1 << 31)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over values[i:i + width], for all full stretches."""
    step, now = 1, values
    while 2 * step <= width:
        now = pick(now[:-step], now[step:])
        step *= 2
    rest = width - step
    return pick(now[:len(now) - rest], now[rest:]) if rest else now


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors in the texts' joined bytes, and the hashes of their grams."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = prefix_hash(data)
    hashes = mixed((sums[GRAM:] - sums[:-GRAM]) * powers(n + 1)[1][:n - GRAM + 1])
    hashes |= np.uint64(1)
    low = _sliding(hashes, LEFT + 1, np.minimum)  # of the window at each place
    # Windows that cross from one text into the next count for nothing.
    size = np.diff(offsets)
    bad = np.zeros(n + 1, np.int32)
    begins = np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1])[size > 0]
    np.add.at(bad, begins, 1)
    np.add.at(bad, offsets[1:][size > 0], -1)
    low[np.cumsum(bad[:-1])[:len(low)] > 0] = 0
    padded = np.zeros(len(low) + 2 * LEFT, np.uint64)
    padded[LEFT:LEFT + len(low)] = low
    best = _sliding(padded, LEFT + 1, np.maximum)
    at = np.flatnonzero(best == hashes)
    return at, hashes[at]


def with_keys(docs: DataFrame) -> DataFrame:
    """doc (long, null as the smallest), h1 and h2 (text hash), text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text.alias("text")).select(
        "doc", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"), "text")


def packed(rows: DataFrame, column: str = "text") -> DataFrame:
    """The rows with a text column as Zstandard frames, for the way through an exchange; null stays null."""
    at = rows.columns.index(column)
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == column else f for f in rows.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                texts_here = part.column(at).cast(pa.binary()).to_pylist()
                blobs = pa.array([None if t is None else pack.compress(t) for t in texts_here], pa.binary())
                yield pa.RecordBatch.from_arrays([blobs if i == at else c for i, c in enumerate(part.columns)], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def gram_blocks(keyed: DataFrame, buckets: int) -> DataFrame:
    """(bucket, key hashes, counts, gram hashes, places): a slice of texts sends one row to each bucket it has grams for.

    Half a hash is enough here: beside the bucket, equal halves only let a suffix travel that has no duplicate after all.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 1):
            # Of equal texts one speaks; those of other slices are met in the bucket.
            part = part.take(pa.array(np.sort(np.unique(np.asarray(part.column(0)), return_index=True)[1])))
            key = np.asarray(part.column(0)).view(np.uint64)
            data, offsets = texts(part.column(1))
            at, gram = anchors(data, offsets)
            owner = np.searchsorted(offsets, at, "right") - 1
            bucket = (gram >> np.uint64(1)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            rows: list[list] = [[], [], [], [], []]
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                own = order[bounds[b]:bounds[b + 1]]
                who, counts = np.unique(owner[own], return_counts=True)
                for out, value in zip(rows, (b, key[who].tobytes(), counts.astype(np.uint32).tobytes(), (gram[own] >> np.uint64(32)).astype(np.uint32).tobytes(),
                                             (at[own] - offsets[owner[own]]).astype(np.uint32).tobytes())):
                    out.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])],
                                             names=["bucket", "keys", "counts", "grams", "places"])

    return keyed.select("key", "text").mapInArrow(run, "bucket int, keys binary, counts binary, grams binary, places binary")


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def shared_anchors(blocks: DataFrame, heavy: int) -> DataFrame:
    """(key, places): the anchors whose gram occurs again at another place or in another text; the top bit marks grams with
    more than `heavy`. A text that several slices sent counts once.

    A bucket answers in one row for each bucket of texts, and those become one row for each text.
    """
    dests = spread_count(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs_of(batches, 1, 1):
            for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                own = table.slice(first, last - first)
                key, counts = _joined(own.column(1), "<u8"), _joined(own.column(2), "<u4")
                gram, place = _joined(own.column(3), "<u4"), _joined(own.column(4), "<u4")
                order = np.argsort(gram, kind="stable")
                sorted_gram = gram[order]
                new = np.ones(len(gram), bool)
                new[1:] = sorted_gram[1:] != sorted_gram[:-1]
                starts = np.flatnonzero(new)
                sizes = np.diff(np.append(starts, len(gram)))
                owner = np.repeat(np.arange(len(key)), counts)
                again = order[np.repeat(sizes, sizes) > 1]
                again = again[np.lexsort((place[again], key[owner[again]], gram[again]))]
                g, k, p = gram[again], key[owner[again]], place[again]
                new = np.ones(len(again), bool)
                new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1]) | (p[1:] != p[:-1])
                again, g = again[new], g[new]
                starts = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
                sizes = np.diff(np.append(starts, len(g)))
                many = np.zeros(len(gram), np.int64)
                many[again] = np.repeat(sizes, sizes)
                keep = np.flatnonzero(many > 1)
                value = place[keep] | np.where(many[keep] > heavy, HEAVY_BIT, np.uint32(0))
                owner = owner[keep]
                ends = np.searchsorted(owner, np.arange(len(key) + 1))
                full = np.flatnonzero(np.diff(ends))
                dest = key[full] % np.uint64(dests)
                rows: list[list] = [[], [], [], []]
                for d in np.unique(dest).tolist():
                    mine = full[dest == d]
                    parts_here = [value[ends[k]:ends[k + 1]] for k in mine.tolist()]
                    for out, v in zip(rows, (d, key[mine].tobytes(), np.diff(ends)[mine].astype(np.uint32).tobytes(),
                                             np.concatenate(parts_here).astype("<u4").tobytes())):
                        out.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])],
                                                 names=["dest", "keys", "counts", "places"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs_of(batches, 1, 1):
            for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                own = table.slice(first, last - first)
                counts = _joined(own.column(2), "<u4")
                key, place = np.repeat(_joined(own.column(1), "<u8"), counts), _joined(own.column(3), "<u4")
                order = np.argsort(key, kind="stable")
                key, raw = key[order], place[order].tobytes()
                starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
                ends = np.append(starts[1:], len(key))
                blobs = [raw[x * 4:y * 4] for x, y in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(key[starts].view(np.int64)), pa.array(blobs, pa.binary())], names=["key", "places"])

    answers = (blocks.repartition(spread_count(blocks), "bucket").sortWithinPartitions("bucket")
               .mapInArrow(run, "dest int, keys binary, counts binary, places binary"))
    return answers.repartition(dests, "dest").sortWithinPartitions("dest").mapInArrow(gather, "key long, places binary")


def common(rows: np.ndarray) -> np.ndarray:
    """How many leading bytes each row of a sorted table shares with the row before it."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def front_coded(rows: np.ndarray) -> tuple[bytes, bytes]:
    """Shared lengths and the other bytes of sorted rows."""
    shared = common(rows)
    return shared.astype(np.uint8).tobytes(), rows[np.arange(rows.shape[1]) >= shared[:, None]].tobytes()


def unpacked(shared: bytes, rest: bytes, width: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.frombuffer(shared, np.uint8).astype(np.int64)
    given = np.arange(width) >= lengths[:, None]
    place = np.cumsum(given.ravel()).reshape(given.shape) - 1
    # A byte that is not given is that of the last row which gives one in this column.
    row = np.maximum.accumulate(np.where(given, np.arange(len(lengths))[:, None], 0), axis=0)
    return np.frombuffer(rest, np.uint8)[place[row, np.arange(width)]], lengths


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Merges sorted runs (rows, length shared with the row before) by a loser tree that keeps common-prefix lengths.

    Returns, for each row in merged order, its number (runs laid end to end) and what it shares with the row before it.
    """
    many = len(runs)
    base, total = [], 0
    for rows, _ in runs:
        base.append(total)
        total += len(rows)
    leaves = 1
    while leaves < many:
        leaves *= 2
    at = [0] * leaves
    ends = [len(r) for r, _ in runs] + [0] * (leaves - many)
    strings = [r for r, _ in runs] + [[]] * (leaves - many)
    shares = [s for _, s in runs] + [[]] * (leaves - many)
    # For each player, what its head shares with the last winner; -1 once the run is empty.
    known = [0 if e else -1 for e in ends]
    losers = [0] * leaves

    def duel(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; updates what the loser shares with the winner."""
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        if ka < 0:
            return a, b
        x, y = strings[a][at[a]][ka:], strings[b][at[b]][ka:]
        if x == y:
            known[b] = ka + len(x)
            return a, b
        gap = (int.from_bytes(x) ^ int.from_bytes(y)).bit_length()
        met = ka + len(x) - (gap + 7) // 8
        if x < y:
            known[b] = met
            return a, b
        known[a] = met
        return b, a

    def build(node: int) -> int:
        if node >= leaves:
            return node - leaves
        winner, losers[node] = duel(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    order, shared = [], []
    for _ in range(total):
        order.append(base[winner] + at[winner])
        shared.append(known[winner])
        at[winner] += 1
        known[winner] = shares[winner][at[winner]] if at[winner] < ends[winner] else -1
        node = (winner + leaves) >> 1
        now, mine = winner, known[winner]
        while node:
            other = losers[node]
            its = known[other]
            if its > mine:
                losers[node] = now
                now, mine = other, its
            elif its == mine and mine >= 0:
                now, losers[node] = duel(now, other)
                mine = known[now]
            node >>= 1
        winner = now
    return order, shared


def earlier(right_class: np.ndarray, left_class: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which rows have a row of the same two classes that comes earlier in `order` (a rank per row)."""
    by = np.lexsort((order, left_class, right_class))
    r, c = right_class[by], left_class[by]
    out = np.zeros(len(order), bool)
    out[by[1:]] = (r[1:] == r[:-1]) & (c[1:] == c[:-1])
    return out


def judged(right: np.ndarray, shared: np.ndarray, left: np.ndarray, right_size: np.ndarray, left_size: np.ndarray,
           rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in merged order: the largest and smallest offset before the anchor at which a window that starts there
    occurs earlier; -1 and LENGTH where none does. `left` holds the bytes before, nearest first."""
    n = len(right)
    largest, smallest = np.full(n, -1), np.full(n, LENGTH)
    # Only suffixes that share a whole gram with a neighbour can matter.
    near = np.zeros(n, bool)
    near[1:] |= shared[1:] >= GRAM
    near[:-1] |= shared[1:] >= GRAM
    rows = np.flatnonzero(near)
    if not len(rows):
        return largest, smallest
    shared = np.where(np.append(-1, rows[:-1]) == rows - 1, shared[rows], 0)
    side = np.ascontiguousarray(left[rows])
    by = np.argsort(side.view(f"V{LEFT}").ravel(), kind="stable") if LEFT else np.arange(len(rows))
    left_shared = common(side[by])
    place = rank[rows]
    for offset in range(LEFT + 1):
        depth = LENGTH - offset
        fits = (left_size[rows] >= offset) & (right_size[rows] >= depth)
        right_class = np.cumsum(shared < depth)
        left_class = np.empty(len(rows), np.int64)
        left_class[by] = np.cumsum(left_shared < offset) if offset else 0
        # A class of one row at this depth needs no look.
        alone = np.bincount(right_class)[right_class] < 2
        todo = np.flatnonzero(fits & ~alone)
        if not len(todo):
            continue
        hit = todo[earlier(right_class[todo], left_class[todo], place[todo])]
        largest[rows[hit]] = offset
        smallest[rows[hit]] = np.minimum(smallest[rows[hit]], offset)
    return largest, smallest


RECORD = np.dtype([("doc", "<i8"), ("h1", "<i8"), ("place", "<u4"), ("right", "u1"), ("left", "u1")])
WINDOW = np.dtype([("k1", "<u8"), ("k2", "<u8"), ("doc", "<i8"), ("h1", "<i8"), ("place", "<u4")])
RUN = "bucket int, kind int, shared binary, rest binary, before binary, records binary, spans binary"


def suffix_runs(rows: DataFrame, buckets: int) -> DataFrame:
    """From (doc, h1, text as a frame, places): front-coded runs for each bucket (kind 0), windows of heavy grams (kind 1), and
    what a slice can tell alone (kind 2: spans of suffixes that it holds twice)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for part in parts(batches, 2, 1 << 20):
            doc, h1 = (np.asarray(part.column(k)).astype(np.int64) for k in (0, 1))
            data, offsets = texts(pa.array([unpack.decompress(b) for b in part.column(2).to_pylist()], pa.binary()))
            places = [np.frombuffer(p, "<u4") for p in part.column(3).to_pylist()]
            owner = np.repeat(np.arange(len(places)), [len(p) for p in places])
            value = np.concatenate(places) if places else np.zeros(0, np.uint32)
            is_heavy, place = (value & HEAVY_BIT) > 0, (value & ~HEAVY_BIT).astype(np.int64)
            size = np.diff(offsets)
            fits = place + GRAM <= size[owner]
            owner, place, is_heavy = owner[fits], place[fits], is_heavy[fits]
            # Rows in document order, so that of equal rows the first is the earliest.
            by = np.lexsort((place, h1[owner], doc[owner]))
            owner, place, is_heavy = owner[by], place[by], is_heavy[by]
            out: list[list] = [[] for _ in range(7)]

            def send(bucket: int, kind: int, *blobs: bytes) -> None:
                for column, v in zip(out, (bucket, kind, *(pack.compress(b) for b in blobs))):
                    column.append(v)

            local = []
            for flag in (False, True):
                who, at = owner[is_heavy == flag], place[is_heavy == flag]
                if not len(who):
                    continue
                if flag:
                    local.append(_heavy_windows(data, offsets, doc, h1, who, at, buckets, send))
                    continue
                padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(LENGTH, np.uint8)])
                begin = at + offsets[who]
                right_size = np.minimum(size[who] - at, LENGTH)
                left_size = np.minimum(at, LEFT)
                right = np.lib.stride_tricks.sliding_window_view(padded, LENGTH)[begin + LEFT]
                right[np.arange(LENGTH) >= right_size[:, None]] = 0
                left = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, LEFT)[begin][:, ::-1])
                left[np.arange(LEFT) >= left_size[:, None]] = 0
                sums = mixed(np.frombuffer(np.ascontiguousarray(right[:, :48]).tobytes(), "<u8").reshape(-1, 6) * MIX1 + np.arange(6, dtype=np.uint64))
                bucket = mixed(sums.sum(1, dtype=np.uint64)) % np.uint64(buckets)
                whole = np.concatenate([right, left, right_size[:, None].astype(np.uint8), left_size[:, None].astype(np.uint8)], 1)
                order = _sorted(whole, bucket)
                whole, bucket = whole[order], bucket[order]
                same = np.zeros(len(order), bool)
                same[1:] = (whole[1:] == whole[:-1]).all(1) & (bucket[1:] == bucket[:-1])
                again = order[same]
                deep, shallow = left_size[again], LENGTH - right_size[again]
                ok = shallow <= deep
                local.append((doc[who[again]][ok], h1[who[again]][ok], (at[again] - deep)[ok], (at[again] - shallow + LENGTH)[ok]))
                first, whole, bucket = order[~same], whole[~same], bucket[~same]
                records = np.zeros(len(first), RECORD)
                records["doc"], records["h1"], records["place"] = doc[who[first]], h1[who[first]], at[first]
                records["right"], records["left"] = right_size[first], left_size[first]
                bounds = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
                for b in np.flatnonzero(np.diff(bounds)).tolist():
                    own = slice(bounds[b], bounds[b + 1])
                    send(b, 0, *front_coded(whole[own, :LENGTH]), whole[own, LENGTH:LENGTH + LEFT].tobytes(), records[own].tobytes(), b"")
            if local:
                d, h, a, z = (np.concatenate([x[k] for x in local]) for k in range(4))
                if len(d):
                    send(int(d[0] ^ h[0]) % buckets, 2, b"", b"", b"", b"", np.stack([d, h, a, z], 1).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()),
                                              *(pa.array(c, pa.binary()) for c in out[2:])],
                                             names=["bucket", "kind", "shared", "rest", "before", "records", "spans"])

    return rows.select("doc", "h1", "text", "places").mapInArrow(run, RUN)


def _sorted(whole: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Stable order by bucket, then bytes: eight bytes at a time, and only where rows still tie."""
    width = -(-whole.shape[1] // 8) * 8
    wide = np.zeros((len(whole), width), np.uint8)
    wide[:, :whole.shape[1]] = whole
    words = wide.view(">u8").astype(np.uint64)
    order = np.lexsort((words[:, 1], words[:, 0], bucket))
    for k in range(2, words.shape[1], 2):
        keys = np.column_stack([bucket[order], words[order, :k]]) if k == 2 else np.column_stack([group[order].astype(np.uint64), words[order, k - 2:k]])
        new = np.ones(len(order), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(1)
        number = np.cumsum(new)
        group = np.empty(len(order), np.int64)
        group[order] = number
        sizes = np.bincount(number)
        tied = np.flatnonzero(sizes[number] > 1)
        if not len(tied):
            break
        rows = order[tied]
        last = words[rows, min(k + 1, words.shape[1] - 1)]
        order[tied] = rows[np.lexsort((last, words[rows, k], group[rows]))]
    return order


def _heavy_windows(data, offsets, doc, h1, who, at, buckets, send) -> tuple[np.ndarray, ...]:
    """Sends the windows around heavy anchors, one for each distinct string; returns the spans of later ones."""
    start = (at[:, None] - np.arange(LEFT + 1)).ravel()
    owner = np.repeat(who, LEFT + 1)
    ok = (start >= 0) & (start + LENGTH <= np.diff(offsets)[owner])
    start, owner = start[ok], owner[ok]
    # A window around two anchors counts once.
    begin, index = np.unique(start + offsets[owner], return_index=True)
    start, owner = start[index], owner[index]
    sums, inverse = prefix_hash(data), powers(len(data) + 1)[1]
    second = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mixed(data.astype(np.uint64) * MIX2 + MIX1) * powers(len(data))[0], out=second[1:])
    k1 = mixed((sums[begin + LENGTH] - sums[begin]) * inverse[begin])
    k2 = mixed((second[begin + LENGTH] - second[begin]) * inverse[begin])
    order = np.lexsort((start, h1[owner], doc[owner], k2, k1))
    same = np.zeros(len(order), bool)
    same[1:] = (k1[order][1:] == k1[order][:-1]) & (k2[order][1:] == k2[order][:-1])
    later, first = order[same], order[~same]
    rows = np.zeros(len(first), WINDOW)
    for name, values in (("k1", k1), ("k2", k2), ("doc", doc[owner]), ("h1", h1[owner]), ("place", start)):
        rows[name] = values[first]
    bucket = rows["k1"] % np.uint64(buckets)
    by = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[by], np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        send(b, 1, b"", b"", b"", rows[by[bounds[b]:bounds[b + 1]]].tobytes(), b"")
    return doc[owner[later]], h1[owner[later]], start[later], start[later] + LENGTH


def merged_spans(runs: DataFrame) -> DataFrame:
    """(doc, h1, start, end) of bytes that occur earlier."""
    names = ["doc", "h1", "start", "end"]

    def rows_of(d, h, a, z) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (d, h, a, z)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()

        def blobs(column: pa.ChunkedArray) -> list[bytes]:
            return [unpack.decompress(b) for b in column.to_pylist()]

        for table, bounds in runs_of(batches, 2, 1):
            for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                own = table.slice(first, last - first)
                kind = own.column(1)[0].as_py()
                if kind == 2:
                    spans = np.frombuffer(b"".join(blobs(own.column(6))), "<i8").reshape(-1, 4)
                    yield rows_of(*spans.T)
                    continue
                records = np.frombuffer(b"".join(blobs(own.column(5))), WINDOW if kind == 1 else RECORD)
                if kind == 1:
                    r = records
                    by = np.lexsort((r["place"], r["h1"], r["doc"], r["k2"], r["k1"]))
                    r = r[by]
                    hit = np.zeros(len(r), bool)
                    hit[1:] = (r["k1"][1:] == r["k1"][:-1]) & (r["k2"][1:] == r["k2"][:-1])
                    start = r["place"][hit].astype(np.int64)
                    yield rows_of(r["doc"][hit], r["h1"][hit], start, start + LENGTH)
                    continue
                rows, ready = [], []
                for shared, rest in zip(blobs(own.column(2)), blobs(own.column(3))):
                    full, lengths = unpacked(shared, rest)
                    rows.append(full)
                    raw = full.tobytes()
                    ready.append(([raw[k:k + LENGTH] for k in range(0, len(raw), LENGTH)], lengths.tolist()))
                order, shared = (np.asarray(x, np.int64) for x in merge(ready))
                records = records[order]
                left = np.frombuffer(b"".join(blobs(own.column(4))), np.uint8).reshape(-1, LEFT)[order]
                rank = np.empty(len(order), np.int64)
                rank[np.lexsort((records["place"], records["h1"], records["doc"]))] = np.arange(len(order))
                deep, shallow = judged(np.concatenate(rows)[order], shared, left, records["right"], records["left"], rank)
                hit = np.flatnonzero(deep >= 0)
                place = records["place"][hit].astype(np.int64)
                yield rows_of(records["doc"][hit], records["h1"][hit], place - deep[hit], place - shallow[hit] + LENGTH)

    return (runs.repartition(spread_count(runs), "bucket", "kind")
            .sortWithinPartitions("bucket", "kind").mapInArrow(run, "doc long, h1 long, start long, end long"))


def spans(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(doc, h1, whole, found): for each text that loses bytes, its spans (not merged); `whole` marks later copies."""
    ship(docs.sparkSession)
    keyed = with_keys(docs)
    narrow = keyed.select("doc", "h1", "h2", F.octet_length("text").alias("size"))
    firsts = (narrow.where(F.col("size") >= LENGTH).groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n"))
              .where("n > 1"))
    copies = saved(narrow.join(firsts, ["h1", "h2"]).where(F.col("doc") != F.col("first")).select("doc", "h1").distinct(), "copies")
    buckets = spread_count(docs)
    hashed = keyed.where(F.octet_length("text") >= LENGTH).select(F.col("h1").alias("key"), "doc", "text")
    wanted = shared_anchors(gram_blocks(hashed, buckets), heavy)
    # A text takes part once, as its first document: neither later copies nor rows that repeat id and text meet it.
    texts_packed = packed(hashed).groupBy("key").agg(F.min("doc").alias("doc"), F.first("text").alias("text"))
    runs = suffix_runs(texts_packed.hint("merge").join(wanted, "key").select("doc", F.col("key").alias("h1"), "text", "places"), buckets)
    found = (merged_spans(runs).groupBy("doc", "h1").agg(F.collect_list(F.struct("start", "end")).alias("found")))
    return found.withColumn("whole", F.lit(False)).unionByName(
        copies.select("doc", "h1", F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("found"), F.lit(True).alias("whole")))


def dedup(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """The rows with kept (binary: the remaining bytes), n_bytes, n_removed and n_spans; columns of these names are replaced."""
    docs, back = aside(docs.drop("kept", "n_bytes", "n_removed", "n_spans"))
    return back(_dedup(docs, heavy))


def _dedup(plain: DataFrame, heavy: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = (plain.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
            .withColumn("_h1", F.xxhash64(text)).withColumn("_size", F.octet_length(text)))
    hits = spans(plain, heavy).select(F.col("doc").alias("_d"), F.col("h1").alias("_h"), "found", "whole")
    here = (F.col("_doc") == F.col("_d")) & (F.col("_h1") == F.col("_h"))
    joined = packed(rows).hint("merge").join(hits, here, "left").drop("_d", "_h")
    # Rows that repeat both id and text: one keeps its place in the order, the others are later copies.
    nth = F.row_number().over(Window.partitionBy("_doc", "_h1").orderBy("_h1"))
    joined = joined.withColumn("_nth", nth)
    late = (F.coalesce(F.col("whole"), F.lit(False)) | (F.col("_nth") > 1)) & (F.col("_size") >= LENGTH)
    ready = joined.withColumn("_late", late)
    fields = plain.schema.fields
    names = plain.columns
    schema = T.StructType(fields + [T.StructField("kept", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in
                                                                            ("n_bytes", "n_removed", "n_spans"))])
    width = len(fields)

    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        slices = (batch.slice(k, 1000) for batch in batches for k in range(0, batch.num_rows, 1000))
        for batch in slices:
            kept, counts = [], []
            found, late = batch.column(width), batch.column(width + 1)
            raw = [None if b is None else unpack.decompress(b) for b in batch.column(place).to_pylist()]
            columns = list(batch.columns[:width])
            columns[place] = pa.array(raw, pa.binary()).cast(pa.string())
            for own, gone, data in zip(found, late.to_pylist(), (b or b"" for b in raw)):
                size, removed, many, out = len(data), 0, 0, data
                if gone:
                    removed, many, out = size, 1, b""
                elif own.is_valid:
                    flat = own.values
                    spans_here = np.stack([np.asarray(flat.field(0)), np.asarray(flat.field(1))], 1)
                    spans_here = spans_here[np.argsort(spans_here[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(spans_here[:, 1])
                    new = np.ones(len(reach), bool)
                    new[1:] = spans_here[1:, 0] > reach[:-1]
                    begins = spans_here[new, 0]
                    stops = reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
                    removed, many = int((stops - begins).sum()), len(begins)
                    edges = [0, *np.stack([begins, stops], 1).ravel().tolist(), size]
                    out = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                kept.append(out)
                counts.append((size, removed, many))
            table = np.asarray(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary()),
                                              *(pa.array(table[:, k]) for k in range(3))], names=schema.fieldNames())

    return ready.select(*names, "found", "_late").mapInArrow(run, schema)


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute(documents: list[tuple[int, str | None]]) -> list[tuple[int, int, int, int, str]]:
    """The plain way, for tests: (doc_id, n_bytes, n_removed, n_spans, kept_sha256) in doc_id order."""
    seen: set[bytes] = set()
    out = []
    for doc, text in sorted(documents, key=lambda d: d[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - LENGTH + 1):
            own = data[k:k + LENGTH]
            if own in seen:
                gone[k:k + LENGTH] = b"\x01" * LENGTH
            seen.add(own)
        flags = bytes(gone)
        kept = bytes(b for b, g in zip(data, flags) if not g)
        out.append((doc, len(data), sum(flags), (b"\0" + flags).count(b"\0\x01"), hashlib.sha256(kept).hexdigest()))
    return out
