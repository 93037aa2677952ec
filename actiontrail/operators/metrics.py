"""Metric points and their running sums per labelled series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Resource attributes that become series labels.
LABEL_RESOURCES = r"\A(service\.name|service\.instance\.id|codex\..*|gen_ai\..*)\z"


def sanitized(name: Column) -> Column:
    """Metric and label names keep letters, digits, `_` and `:`."""
    clean = F.regexp_replace(name, r"[^A-Za-z0-9_:]", "_")
    return F.when(clean.rlike(r"\A[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def points(raw: DataFrame) -> DataFrame:
    """`raw`: name, resource map, attributes map, as_int, as_double."""
    kept = F.map_filter("resource", lambda k, _: k.rlike(LABEL_RESOURCES))
    attrs = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
    # Overlay without relying on the session's duplicate-key policy.
    base = F.map_filter(kept, lambda k, _: ~F.map_contains_key(attrs, k))
    value = F.when(F.coalesce(F.col("as_double"), F.lit(0.0)) != 0, F.col("as_double")).otherwise(
        F.coalesce(F.col("as_int").cast("double"), F.lit(0.0)))
    return raw.select("name", F.map_concat(base, attrs).alias("labels"), value.alias("value"))


def series_key(labels: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def rollup(pts: DataFrame) -> DataFrame:
    return (pts.select(sanitized(F.col("name")).alias("name"), series_key(F.col("labels")).alias("labels"),
                       "value")
            .groupBy("name", "labels").agg(F.sum("value").alias("value")))
