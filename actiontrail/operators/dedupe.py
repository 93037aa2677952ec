"""Keep-first, keep-last and conflict checks by id.

Only ids and orders are aggregated, in buffers of fixed width that hash
aggregation can hold; whole rows then meet the kept orders in a join, whose
large side Spark may split. A window would send every copy of a repeated id to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from actiontrail.functions.scalars import present


def _pick(df: DataFrame, keys: Sequence[str], order: str, last: bool) -> DataFrame:
    """`order` is unique among the rows of a key."""
    choose = F.max if last else F.min
    kept = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(choose(order).alias("_o"))
    same = F.col(order) == F.col("_o")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(kept, same, "left_semi")


def first_per_id(df: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """First row per id by `order`. Rows without an id all stay."""
    keys = [key] if isinstance(key, str) else list(key)
    has_id = present(F.col(keys[-1]).cast("string"))
    # Rows without an id get their own position as key, which keeps one plan
    # and one exchange instead of a union of two scans.
    solo = F.when(~has_id, F.col(order))
    return _pick(df.withColumn("_solo", solo), [*keys, "_solo"], order, last=False).drop("_solo")


def last_per_id(df: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return _pick(df, keys, order, last=True)


def upsert(messages: DataFrame, key: str | Sequence[str], order: str,
           last: Sequence[str], first: Sequence[str]) -> DataFrame:
    """Merge versions of a record: `last` columns take the newest version,
    `first` columns the oldest version that carries them."""
    keys = [key] if isinstance(key, str) else list(key)
    o = F.col(order)
    # Which version each column comes from: numbers only, so the aggregate hashes.
    marks = [F.max(o).alias("_last"), *[F.min(F.when(F.col(c).isNotNull(), o)).alias(f"_first{i}") for i, c in enumerate(first)]]
    kept = messages.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*marks, F.count("*").alias("versions"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    wanted = o == F.col("_last")
    for i in range(len(first)):
        wanted = wanted | (o == F.col(f"_first{i}"))
    rows = messages.join(kept, same & wanted)
    # At most one row for each mark is left of a key.
    aggs = [F.max(F.when(o == F.col("_last"), F.struct(*last))).alias("_row")]
    aggs += [F.max(F.when(o == F.col(f"_first{i}"), F.col(c))).alias(c) for i, c in enumerate(first)]
    out = rows.groupBy(*keys).agg(*aggs, F.max("versions").alias("versions"))
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in last], *first, "versions")


def content_digest(df: DataFrame, ignore: Sequence[str] = ()) -> Column:
    cols = sorted(c for c in df.columns if c not in ignore)
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def conflicts(records: DataFrame, key: str, envelope: Sequence[str] = ()) -> DataFrame:
    """Ids whose copies differ once the envelope columns are ignored."""
    digest = content_digest(records, [*envelope])
    return (records.select(F.col(key), digest.alias("_d"))
            .groupBy(key)
            .agg(F.count("*").alias("copies"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
            .where(F.col("_lo") != F.col("_hi"))
            .select(key, "copies"))
