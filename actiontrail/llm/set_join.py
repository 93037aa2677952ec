"""Jaccard self-join of word-shingle sets by chosen paths.

1. `sketches`: each text's set of five-word shingles becomes a 64-bit set fingerprint and `WIDTH` min-hash values. Texts
   with equal sets are one node from here on; nodes carry how many rows they stand for.
2. `paths`: each run splits the nodes recursively. A tree node picks one sampled coordinate, and a second one in a
   quarter of the cases; the children are the nodes that share the token there. Which coordinate is picked depends
   on the path alone, so every set finds its own paths, and only path sizes are counted across tasks.
   Paths end at depth `START_DEPTH`; those that still hold more than `BUCKET` nodes split on, to `MAX_DEPTH` at most.
3. `candidates`: small buckets are compared pair by pair on their sketches; of the pairs that may reach the threshold
   only a spanning forest is kept. Buckets that stay large are dealt out as tiles of two blocks each.
   Runs repeat until a pair at the threshold is missed with at most the chance 1 - `recall`.
4. `exact_links`: inside each connected part of the candidates all nodes are compared exactly, tile by tile: every link
   is counted, and a spanning forest of links gives the classes. No pair is written out.

Words are runs without ASCII white space; a text of one to four words has one shingle; texts without words, null or
empty, have no links and a class of their own each. class_id is the smallest doc_id of a class (nulls last), n_links
the number of other rows that are linked. Repeated rows are copies. Columns named like those added are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actiontrail.llm.groups import components, forest, runs_of
from actiontrail.llm.shared import aside, ranked, saved, ship, spread_count
from actiontrail.llm.text_bytes import mixed, parts, prefix_hash, span_hash, texts

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
WIDTH = 128
BUCKET = 512
TILE = 1024
START_DEPTH, MAX_DEPTH = 2, 4
SECOND = 0.25  # how often a path takes a second coordinate
SLACK = 4.5  # standard errors below the threshold at which a sketch still counts
K1, K2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _factors() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(20240607))
    return draw.integers(0, 1 << 32, WIDTH, np.uint32) | np.uint32(1), draw.integers(0, 1 << 32, WIDTH, np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, sorted inside it, and the text of each."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    words = span_hash(prefix_hash(data), starts, ends)
    counts = np.bincount(owner, minlength=len(offsets) - 1)
    firsts = np.cumsum(counts) - counts
    # Short texts have one shingle of all their words; the missing places add nothing.
    place = np.arange(len(words)) - firsts[owner]
    begins = np.flatnonzero((place + SHINGLE <= counts[owner]) | ((place == 0) & (counts[owner] < SHINGLE)))
    value = np.zeros(len(begins), np.uint64)
    for k in range(SHINGLE):
        at = np.minimum(begins + k, max(len(words) - 1, 0))
        inside = (begins + k < len(words)) & (owner[at] == owner[begins]) if len(begins) else np.zeros(0, bool)
        value = value * np.uint64(0x100000001B3) + np.where(inside, words[at] if len(words) else 0, 0).astype(np.uint64)
    value, of = mixed(value), owner[begins]
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    return value[new], of[new]


def sketches(docs: DataFrame) -> DataFrame:
    """From (doc_id, text, text_hash): node (set fingerprint, null for texts without words) and sketch (WIDTH unsigned
    32-bit numbers) beside doc_id and text_hash."""
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    multiply, add = _factors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 1):
            many = part.num_rows
            value, of = shingles(*texts(part.column(1)))
            sizes = np.bincount(of, minlength=many)
            full = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[full]
            small = (value >> np.uint64(32)).astype(np.uint32)
            table = np.zeros((len(full), WIDTH), np.uint32)
            node = np.zeros(many, np.uint64)
            if len(full):
                for k in range(WIDTH):
                    table[:, k] = np.minimum.reduceat(small * multiply[k] + add[k], starts)
                node[full] = mixed(np.add.reduceat(mixed(value ^ K1), starts) + mixed(sizes[full].astype(np.uint64)))
            raw = table.tobytes()
            blobs: list[bytes | None] = [None] * many
            for k, row in enumerate(full.tolist()):
                blobs[row] = raw[k * WIDTH * 4:(k + 1) * WIDTH * 4]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(node.view(np.int64), mask=sizes == 0), pa.array(blobs, pa.binary())],
                names=["doc_id", "text_hash", "node", "sketch"])

    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, f"doc_id {id_type}, text_hash long, node long, sketch binary")


def survival(depth: int, similarity: float = THRESHOLD) -> float:
    """The chance that one run still holds a pair of this similarity in a common path at this depth."""
    q = 1.0
    for _ in range(depth):
        p = similarity * q
        q = (1 - SECOND) * p + SECOND * (1 - (1 - p) ** 2)
    return q


def least_shared(threshold: float = THRESHOLD) -> float:
    """How many coordinates a pair has to share to count as a candidate."""
    return WIDTH * threshold - SLACK * math.sqrt(WIDTH * threshold * (1 - threshold))


def missed(runs: int, threshold: float = THRESHOLD) -> float:
    """The chance that a pair at the threshold is no candidate after so many runs down to `MAX_DEPTH`.

    All runs draw from one sketch, so they are independent only once it is known how many of its coordinates the pair shares; pairs
    that share too few are missed by any number of runs.
    """
    out = 0.0
    for k in range(WIDTH + 1):
        odds = math.comb(WIDTH, k) * threshold ** k * (1 - threshold) ** (WIDTH - k)
        out += odds * ((1 - survival(MAX_DEPTH, k / WIDTH)) ** runs if k >= least_shared(threshold) else 1.0)
    return out


def runs_needed(recall: float = RECALL) -> int:
    floor = missed(100_000)
    if floor >= 1 - recall:
        raise ValueError(f"sketches of {WIDTH} coordinates reach a recall of {1 - floor:.6f} at most")
    runs = 1
    while missed(runs) > 1 - recall:
        runs += 1
    return runs


def _children(path: np.ndarray, sketch: np.ndarray, shared: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The next paths of each set: path hashes and the row that each belongs to."""
    rows = np.arange(len(sketch))
    out, of = [], []
    for turn in (0, 1):
        draw = mixed(path + np.uint64(turn + 1) * K2)
        coordinate = (draw % np.uint64(WIDTH)).astype(np.int64)
        takes = rows if turn == 0 else np.flatnonzero((draw >> np.uint64(40)) < np.uint64(int(SECOND * (1 << 24))))
        own, at = path[takes], coordinate[takes]
        out.append(mixed(own + mixed(at.astype(np.uint64) * K1 + sketch[takes, at])))
        of.append(takes)
    return np.concatenate(out), np.concatenate(of)


def _sketch_table(column: pa.Array) -> np.ndarray:
    data, _ = texts(column)
    return np.frombuffer(data.tobytes(), np.uint32).reshape(-1, WIDTH)


def first_paths(nodes: DataFrame, runs: int, depth: int = START_DEPTH) -> DataFrame:
    """(path, node) of every run at `depth`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, table = np.asarray(batch.column(0)), _sketch_table(batch.column(1))
            for k in range(runs):
                path = np.full(len(node), mixed(np.asarray([k + 1], np.uint64) * K2)[0])
                of = np.arange(len(node))
                for _ in range(depth):
                    path, chosen = _children(path, table[of])
                    of = of[chosen]
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(node[of])], names=["path", "node"])

    return nodes.select("node", "sketch").mapInArrow(run, "path long, node long")


def next_paths(rows: DataFrame) -> DataFrame:
    """One level deeper for (path, node, sketch)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, of = _children(np.asarray(batch.column(0)).view(np.uint64), _sketch_table(batch.column(2)))
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), batch.column(1).take(pa.array(of))],
                                             names=["path", "node"])

    return rows.select("path", "node", "sketch").mapInArrow(run, "path long, node long")


def _all_pairs(sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs inside groups of bounded size."""
    left, right = [], []
    for size in np.unique(sizes[sizes > 1]).tolist():
        a, b = np.triu_indices(size, 1)
        first = starts[sizes == size]
        left.append((first[:, None] + a).ravel())
        right.append((first[:, None] + b).ravel())
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def near_forest(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b) from (path, i, j, side, node, sketch): a forest of pairs whose sketches may reach the threshold.

    Rows of one (path, i, j) are a bucket; in tiles of two blocks (i < j) only pairs across `side` count.
    """
    least = least_shared(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs_of(batches, 3):
            side, node = table.column(3).to_numpy(), table.column(4).to_numpy()
            sketch = _sketch_table(table.column(5).combine_chunks())
            sizes, starts = np.diff(bounds), bounds[:-1]
            found = []
            left, right = _all_pairs(np.where(sizes <= 32, sizes, 0), starts)
            for k in range(0, len(left), 50_000):
                a, b = left[k:k + 50_000], right[k:k + 50_000]
                ok = ((sketch[a] == sketch[b]).sum(1) >= least) & ((side[a] < 0) | (side[a] != side[b]))
                found.append(np.stack([a[ok], b[ok]], 1))
            for first, size in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist()):
                own = sketch[first:first + size]
                for k in range(0, size, 32):
                    same = (own[k:k + 32, None, :] == own[None, k:, :]).sum(2) >= least
                    a, b = np.nonzero(same)
                    a, b = a + k + first, b + k + first
                    ok = (a < b) & ((side[a] < 0) | (side[a] != side[b]))
                    a, b = a[ok], b[ok]
                    keep = forest(size, a - first, b - first)
                    found.append(np.stack([a[keep], b[keep]], 1))
            if found:
                pairs = np.concatenate(found)
                keep = forest(table.num_rows, pairs[:, 0], pairs[:, 1])
                a, b = node[pairs[keep, 0]], node[pairs[keep, 1]]
                links = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    placed = rows.select("path", "i", "j", "side", "node", "sketch").repartition("path", "i", "j")
    return placed.sortWithinPartitions("path", "i", "j").mapInArrow(run, "a long, b long")


def tiled(rows: DataFrame, group: str, tile: int) -> DataFrame:
    """Deals each group's rows into blocks of `tile` and adds (i, j, side): a row stands in each tile of its block.

    Groups of up to one block are one tile with side -1. Larger ones have a tile for each two blocks, so all their
    pairs meet exactly once and no task holds more than two blocks of a group.
    """
    sized = rows.join(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_size")), group)
    small = sized.where(F.col("_size") <= tile).withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(-1)})
    big = ranked(sized.where(F.col("_size") > tile), group, ["node"], spread_count(rows), "_rank")
    last = F.floor((F.col("_size") - 1) / tile).cast("int")
    big = big.withColumn("_block", F.floor(F.col("_rank") / tile).cast("int"))
    big = big.withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
    same = F.col("_other") == F.col("_block")
    big = big.withColumns({"i": F.least("_block", "_other"), "j": F.greatest("_block", "_other"),
                           "side": F.when(same, F.lit(-1)).otherwise((F.col("_block") > F.col("_other")).cast("int"))})
    return small.drop("_size").unionByName(big.drop("_size", "_rank", "_block", "_other"))


def candidates(nodes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between nodes of which `nodes` has one row each (node, sketch)."""
    wanted, depth = first_paths(nodes, runs_needed(recall)), START_DEPTH
    found = None
    while True:
        rows = saved(wanted, "paths")
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = saved(rows.join(sizes, "path").join(nodes.select("node", "sketch"), "node"), "buckets")
        done = shared if depth == MAX_DEPTH else shared.where(F.col("n") <= bucket)
        if depth == MAX_DEPTH:
            placed = tiled(done.drop("n"), "path", bucket)
        else:
            placed = done.drop("n").withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(-1)})
        links = near_forest(placed, threshold)
        found = links if found is None else found.union(links)
        if depth == MAX_DEPTH or not shared.where(F.col("n") > bucket).limit(1).count():
            return found.distinct()
        wanted, depth = next_paths(shared.where(F.col("n") > bucket)), depth + 1


def set_rows(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, values): the sorted 64-bit shingles of each wanted (node, pick) from (doc_id, text, text_hash)."""
    picks = wanted.select("node", F.col("pick.doc_id").alias("_doc"), F.col("pick.text_hash").alias("_hash"))
    # The same join at every size: a broadcast that only small inputs get would hide what large ones shuffle.
    rows = keyed.hint("merge").join(picks, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 1):
            value, of = shingles(*texts(part.column(1)))
            ends = np.cumsum(np.bincount(of, minlength=part.num_rows)) * 8
            raw = value.tobytes()
            blobs = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], names=["node", "values"])

    return rows.mapInArrow(run, "node long, values binary").dropDuplicates(["node"])


def overlaps(values: np.ndarray, of: np.ndarray, many: int, step: int = 2048) -> np.ndarray:
    """How many values each two of `many` sets share."""
    distinct, number, counts = np.unique(values, return_inverse=True, return_counts=True)
    again = counts > 1
    column = np.cumsum(again) - 1
    keep = again[number]
    column, of = column[number[keep]], of[keep]
    order = np.argsort(column, kind="stable")
    column, of = column[order], of[order]
    out = np.zeros((many, many), np.float32)
    for first in range(0, int(again.sum()), step):
        a, b = np.searchsorted(column, [first, first + step])
        block = np.zeros((many, step), np.float32)
        block[of[a:b], column[a:b] - first] = 1
        out += block @ block.T
    return out


def exact_links(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, n) from (root, i, j, side, node, copies, values): rows with b null count n linked rows of node a in a
    tile; the others are a spanning forest of links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs_of(batches, 3, 500):
            side, node, copies = (table.column(k).to_numpy() for k in (3, 4, 5))
            blob, offsets = texts(table.column(6).combine_chunks())
            every = np.frombuffer(blob.tobytes(), np.uint64)
            ends = offsets // 8
            one, two, count = [], [], []
            for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                many = last - first
                sizes = np.diff(ends[first:last + 1])
                shared = overlaps(every[ends[first]:ends[last]], np.repeat(np.arange(many), sizes), many)
                union = sizes[:, None] + sizes[None, :] - shared
                link = shared >= threshold * union - 1e-6
                np.fill_diagonal(link, False)
                own = side[first:last]
                if own[0] >= 0:
                    link &= own[:, None] != own[None, :]
                sums = link @ copies[first:last].astype(np.float64)
                a, b = np.nonzero(np.triu(link))
                keep = forest(many, a, b)
                hit = np.flatnonzero(sums)
                one += [node[first + hit], node[first + a[keep]]]
                two += [np.full(len(hit), -1), first + b[keep]]
                count += [sums[hit].astype(np.int64), np.zeros(len(keep), np.int64)]
            if one:
                other = np.concatenate(two).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(one)), pa.array(node[np.maximum(other, 0)], mask=other < 0), pa.array(np.concatenate(count))],
                    names=["a", "b", "n"])

    placed = rows.select("root", "i", "j", "side", "node", "copies", "values").repartition("root", "i", "j")
    return placed.sortWithinPartitions("root", "i", "j").mapInArrow(run, "a long, b long, n long")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, text_hash, root (its class, null for texts without words), class_id, n_links."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sketched = saved(sketches(keyed), "sketches")
    nodes = saved(sketched.where("node IS NOT NULL").groupBy("node")
                  .agg(F.min(F.struct("doc_id", "text_hash")).alias("pick"), F.min("doc_id").alias("low"),
                       F.min("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")), "nodes")
    linked = saved(candidates(nodes, threshold, recall), "candidates")
    members = saved(components(linked).join(nodes.select("node", "pick", "copies"), "node"), "parts")
    sets = saved(set_rows(keyed, members.select("node", "pick")), "sets")
    whole = tiled(members.select("root", "node", "copies"), "root", TILE).join(sets, "node")
    links = saved(exact_links(whole, threshold), "exact-links")
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    classes = components(links.where("b IS NOT NULL").select("a", "b"))
    named = classes.join(nodes.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("class_low"))
    labels = (nodes.select("node", "low", "copies").join(classes, "node", "left").join(named, "root", "left")
              .join(counts, "node", "left")
              .select("node", F.coalesce("root", "node").alias("root"), F.coalesce("class_low", "low").alias("class_id"),
                      (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")))
    return (sketched.select("doc_id", "text_hash", "node").join(labels, "node", "left")
            .select("doc_id", "text_hash", "root", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
                    .alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")))


def first_of_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of which one of each class stays: that with the smallest doc_id. Texts without words all stay, repeated
    rows of them once."""
    docs, back = aside(docs)
    classes = saved(near_classes(docs, threshold), "classes")
    pick = F.min(F.struct("doc_id", "text_hash")).alias("pick")
    # A text without words is a class of its own.
    first = classes.groupBy("root", F.when(F.col("root").isNull(), F.struct("doc_id", "text_hash")).alias("own")).agg(pick)
    keys = first.select(F.col("pick.doc_id").alias("_doc"), F.col("pick.text_hash").alias("_hash"))
    rows = docs.withColumn("_text_hash", F.xxhash64("text"))
    here = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_hash"))
    return back(rows.join(keys, here, "left_semi").dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash"))


def class_report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links."""
    return near_classes(docs).select("doc_id", "class_id", "n_links")
