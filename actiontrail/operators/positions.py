"""Dense positions inside a group without sorting a whole group in one task.

Arrival order is cut into slices of bounded size. Rows are counted per
(group, slice) with map-side combining, the small count table is prefix-summed,
and only rows of one (group, slice) meet in a task. A group that holds a third
of the data is therefore spread over as many tasks as it has slices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from actiontrail.session import saved

SLICE_ROWS = 1 << 20


def add_positions(df: DataFrame, keys: Sequence[str], seq: str, name: str = "pos",
                  slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add a 0-based position per group. `seq` is unique within a group."""
    sliced = df.withColumn("_slice", F.floor(F.col(seq) / F.lit(slice_rows)))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
               .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .drop("_n"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(seq)
    return (sliced.join(offsets, [*keys, "_slice"])
            .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
            .drop("_slice", "_offset"))


def number_in_order(df: DataFrame, order: Sequence[str], name: str, parts: int | None = None) -> DataFrame:
    """Add a 1-based number in the order of all rows; rows that are equal in `order` are numbered in any order.

    Rows are dealt by ranges of the order and saved with their range; each range is numbered by itself, behind the counts
    of the ranges before it, of which there are as many as tasks.
    """
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    dealt = saved(dealt.withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (dealt.withColumn(name, F.row_number().over(inside)).join(F.broadcast(starts), F.col("_part") == F.col("_of"))
            .withColumn(name, (F.col(name) + F.col("_start")).cast("long")).drop("_part", "_of", "_start"))


def carry(df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, Column],
          inclusive: bool = True, backward: bool = False, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add, per name, the latest non-null value up to the row (or just before it).

    Works like `add_positions`: the last value of each slice is found by a
    two-phase aggregate, handed to the following slices over the small slice
    table, and completed inside a slice. `backward` looks from the other end.
    `order` is a whole number, unique in its group.
    """
    at = -F.col(order) if backward else F.col(order)
    names = list(values)
    raw = {f"_v{i}": values[n] for i, n in enumerate(names)}
    # Null members of a struct key compare as equal, so no row is lost to a null key.
    rows = df.withColumns({"_g": F.struct(*keys), "_at": at.cast("bigint"), **raw}).withColumn(
        "_slice", F.floor(F.col("_at") / F.lit(slice_rows)))
    ends = rows.groupBy("_g", "_slice").agg(*[
        F.max_by(v, F.when(F.col(v).isNotNull(), F.col("_at"))).alias(v) for v in raw])
    earlier = Window.partitionBy("_g").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select("_g", "_slice", *[F.last(v, ignorenulls=True).over(earlier).alias("_h" + v) for v in raw])
    inside = (Window.partitionBy("_g", "_slice").orderBy("_at")
              .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    joined = rows.join(handed, ["_g", "_slice"])
    out = joined.withColumns({n: F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col("_h" + v))
                              for n, v in zip(names, raw, strict=True)})
    return out.drop("_g", "_at", "_slice", *raw, *["_h" + v for v in raw])
