"""Session timelines: rollups, ordered events, bounded nested pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from actiontrail.functions.scalars import (evidence_ref, order_key, present, step_detail)
from actiontrail.operators.positions import SLICE_ROWS, carry
from actiontrail.schema import SEQ

SESSION_KEYS = ["source_agent", "source_type", "session_id", "boundary"]


def with_session(events: DataFrame) -> DataFrame:
    """Fill the grouping columns; events without a session get a boundary."""
    kind = F.when(present("source_type"), F.col("source_type")).otherwise(F.lit("artifact"))
    fallback = (F.when((kind == "artifact") & present("evidence.local_path"),
                       F.concat(F.lit("artifact:"), F.col("evidence.local_path")))
                .when(present("event_id"), F.concat(F.lit("event:"), F.col("event_id")))
                .otherwise(F.concat(F.lit("event-index:"), F.col(SEQ).cast("string"))))
    return events.withColumns({
        "boundary": F.when(present("session_id"), F.lit("")).otherwise(fallback),
        "source_agent": F.coalesce("source_agent", F.lit("")),
        "source_type": kind,
        "session_id": F.coalesce("session_id", F.lit(""))})


def session_rollup(events: DataFrame) -> DataFrame:
    """One row per session: start, end, first project, event count."""
    key = order_key("timestamp")
    rows = with_session(events).select(
        *SESSION_KEYS, F.when(present("timestamp"), key).alias("_k"),
        F.when(present("project_path"),
               F.struct(key.alias("k"), F.col(SEQ), F.col("project_path"))).alias("_p"))
    return rows.groupBy(*SESSION_KEYS).agg(
        F.min("_k").alias("_lo"), F.max("_k").alias("_hi"),
        F.min("_p").alias("_p"), F.count("*").alias("event_count"),
    ).select(*SESSION_KEYS, F.col("_p.project_path").alias("project_path"),
             F.col("_lo.raw").alias("start"), F.col("_hi.raw").alias("end"), "event_count")


def session_order(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(order_key("start"), *SESSION_KEYS)


def ordered_events(events: DataFrame) -> DataFrame:
    """Add `step`: the 1-based place of an event in its session.

    The order is by timestamp, so slices of a session are cut by time: rows
    are counted per (session, minute), prefix-summed, and ranked per minute.
    """
    key = order_key("timestamp")
    rows = with_session(events).withColumn("_k", key)
    rows = rows.withColumn("_cut", F.struct(
        F.col("_k.class").alias("class"),
        F.floor(F.unix_micros("_k.instant") / 60_000_000).alias("minute"),
        # Rows without a usable instant have no minute: their whole text orders them, and equal
        # texts and missing ones follow arrival, of which a slice is bounded.
        F.when(F.col("_k.class") == 2, F.col("_k.raw")).alias("junk"),
        F.when(F.col("_k.class") != 1, F.floor(F.col(SEQ) / SLICE_ROWS)).alias("slice")))
    keys = [*SESSION_KEYS]
    before = Window.partitionBy(*keys).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(*keys, "_cut").agg(F.count("*").alias("_n"))
               .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = Window.partitionBy(*keys, "_cut").orderBy("_k", SEQ)
    # Struct keys compare their null members as equal.
    return (rows.join(offsets, [*keys, "_cut"])
            .withColumn("step", F.col("_offset") + F.row_number().over(inside))
            .drop("_k", "_cut", "_offset"))


def timeline(events: DataFrame) -> DataFrame:
    return ordered_events(events).select(
        *SESSION_KEYS, "step", "timestamp", "event_type", "actor", "event_id",
        step_detail().alias("detail"), evidence_ref().alias("evidence_ref"), "tags")


def timeline_pages(events: DataFrame, page_rows: int = 1000) -> DataFrame:
    """Nested events in pages of bounded size, so no session is one row."""
    rows = timeline(events).withColumn("page", F.floor((F.col("step") - 1) / page_rows))
    body = F.struct("step", "timestamp", "event_type", "actor", "event_id", "detail",
                    "evidence_ref", "tags")
    return rows.groupBy(*SESSION_KEYS, "page").agg(
        F.array_sort(F.collect_list(body)).alias("events"))


# --- carried context ---------------------------------------------------------

def carry_forward(df: DataFrame, columns: list[str], group: list[str], order: str) -> DataFrame:
    """Fill each column with its latest earlier value inside the group."""
    return carry(df, group, order, {c: F.col(c) for c in columns})


def changes_only(df: DataFrame, column: str, group: list[str], order: str) -> DataFrame:
    """Rows whose value differs from the previous one in the group."""
    before = carry(df, group, order, {"_prev": F.struct(F.col(column).alias("v"))}, inclusive=False)
    return before.where(F.col("_prev").isNull() | ~F.col("_prev.v").eqNullSafe(F.col(column))).drop("_prev")


def bookends(rows: DataFrame, group: list[str], order: str, session: str,
             context: list[str], timestamp: str, line: str) -> tuple[DataFrame, DataFrame]:
    """Synthetic session start (first row with an id, context back-filled from
    the first value seen) and end (last timestamp and line)."""
    o = F.col(order)
    has = F.when(F.col(session).isNotNull(), o)
    agg = rows.groupBy(*group).agg(
        F.min_by(session, has).alias("session_id"),
        F.min_by(F.struct(timestamp, line), has).alias("_start"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), o)).alias(c) for c in context],
        F.max_by(timestamp, F.when(F.col(timestamp).isNotNull(), o)).alias("_end_ts"),
        F.max_by(line, o).alias("_end_line")).where(F.col("session_id").isNotNull())
    start = agg.select(*group, "session_id", *context, F.col(f"_start.{timestamp}").alias("timestamp"),
                       F.col(f"_start.{line}").alias("line"))
    end = agg.select(*group, "session_id", *context, F.col("_end_ts").alias("timestamp"),
                     F.col("_end_line").alias("line"))
    return start, end

