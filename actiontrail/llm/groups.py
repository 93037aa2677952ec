"""Small graph and grouping helpers: connected components as joins, and groups of sorted Arrow rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actiontrail.llm.shared import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), both longs: root is the smallest node it is connected to.

    Alternates large-star and small-star steps, whose rounds grow with the logarithm of the number of nodes. Each round is
    written to the shared folder; only two numbers come to the driver.
    """
    now = saved(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Every edge now points from the larger node to a smaller one.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
                 .where("a != b").distinct())
        now = saved(small, "links")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(seen):
            break
        mark = tuple(seen)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()


def runs_of(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows sorted by their first `keys` columns: tables of at least `rows` rows where there are as
    many, with the places at which groups begin and the end."""
    held: list[pa.RecordBatch] = []
    count = 0

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in range(keys):
            values = table.column(k).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            ends = bounds(table)
            if len(ends) > 2:
                yield table.slice(0, int(ends[-2])), ends[:-1]
                held = table.slice(int(ends[-2])).to_batches()
                count = table.num_rows - int(ends[-2])
            else:
                held, count = table.to_batches(), 0
    if held:
        table = pa.Table.from_batches(held)
        yield table, bounds(table)


def forest(many: int, left: np.ndarray, right: np.ndarray) -> list[int]:
    """Which of the edges (left, right) over `many` nodes join two parts: a spanning forest."""
    up = list(range(many))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append(k)
    return out
