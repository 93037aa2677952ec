"""Run summaries, coverage reports, bounded diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from actiontrail.functions.scalars import order_key, present

MAX_REPEATS = 3
MAX_PER_ARTIFACT = 20


def run_summary(counts: DataFrame, truncated: bool = False) -> DataFrame:
    """`counts`: kind, n, and for artifacts the parsed / failed split.

    Kinds: artifact_parsed, artifact_failed, event, finding, indicator, diagnostic,
    record_error.
    """
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    agg = counts.agg(
        total("artifact_parsed").alias("artifacts_scanned"), total("artifact_failed").alias("_failed"),
        total("event").alias("events_emitted"), total("finding").alias("findings_emitted"),
        total("indicator").alias("indicators_emitted"), total("diagnostic").alias("diagnostics"),
        total("record_error").alias("_errors"))
    status = (F.when(F.col("artifacts_scanned") == 0, "error")
              .when((F.col("_failed") > 0) | (F.col("_errors") > 0) | F.lit(truncated), "partial")
              .otherwise("complete"))
    return agg.withColumn("status", status).drop("_failed", "_errors")


def kind_counts(**frames: DataFrame) -> DataFrame:
    """One `(kind, n)` row per frame; every count is a distributed aggregate."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
             for kind, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coverage(artifacts: DataFrame, events: DataFrame) -> DataFrame:
    """Per agent: artifacts found, artifacts with events, events, last activity."""
    found = artifacts.groupBy("source_agent").agg(F.count("*").alias("artifacts_found"))
    # Distinct paths per agent in two aggregates, so no path list is held.
    per_path = events.groupBy("source_agent", F.col("evidence.local_path").alias("p")).agg(
        F.count("*").alias("n"),
        F.max(F.when(present("timestamp"), order_key("timestamp"))).alias("k"))
    seen = per_path.groupBy("source_agent").agg(
        F.count("p").alias("artifacts_parsed"), F.sum("n").alias("events"),
        F.max("k").alias("_k"))
    return (found.join(seen, "source_agent", "full_outer")
            .select("source_agent",
                    *[F.coalesce(c, F.lit(0)).alias(c) for c in
                      ("artifacts_found", "artifacts_parsed", "events")],
                    F.col("_k.raw").alias("last_seen")))


def cap_diagnostics(diagnostics: DataFrame, order: str = "line") -> DataFrame:
    """Bound repeats of a message and rows per artifact; say that it happened.

    Literal rank bounds are pushed below the exchange by Spark, so a file with
    millions of bad lines sends only its first few per task.
    """
    tail = ["path", order, "message"]
    same = Window.partitionBy("path", "message").orderBy(order)
    kept = diagnostics.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= MAX_REPEATS)
    each = Window.partitionBy("path").orderBy(order, "message")
    kept = (kept.withColumn("_n", F.row_number().over(each))
            .where(F.col("_n") < MAX_PER_ARTIFACT).select(*tail, F.col("_n")))
    total = diagnostics.groupBy("path").agg(F.count("*").alias("_total"))
    shown = kept.groupBy("path").agg(F.count("*").alias("_shown"))
    notes = (total.join(shown, "path").where(F.col("_total") > F.col("_shown"))
             .select("path", F.lit(None).cast(diagnostics.schema[order].dataType).alias(order),
                     F.lit("additional diagnostics suppressed").alias("message")))
    return kept.select(*tail).unionByName(notes)
