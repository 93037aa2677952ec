"""Calls and results: earlier-owner, as-of, late-failure pairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from actiontrail.operators.positions import SLICE_ROWS, carry
from actiontrail.session import saved, ship

# Rows of a conversation that one task pairs, and how many such slices are merged at once.
OPEN_SLICE = 1 << 16
OPEN_FAN = 64


def earlier_owner(rows: DataFrame, group: Sequence[str], call_id: str, order: str,
                  owner: Column, name: str) -> DataFrame:
    """The newest earlier row of the same call id that offers `owner`.

    A reused id belongs to its newest call. `owner` is null on rows that are
    not calls; `call_id` is filled on every row.
    """
    found = carry(rows, [*group, call_id], order, {name: owner}, inclusive=False)
    return found.withColumn(name, F.when(F.col(call_id).isNotNull(), F.col(name)))


def as_of_unmatched(rows: DataFrame, group: Sequence[str], name: str, order: str,
                    is_call: Column, is_response: Column, payload: Column,
                    out: str = "matched", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Pair each response with the most recent unanswered call of its name.

    Calls and responses nest like brackets. A running balance that never falls
    below zero gives every call its depth and every response the depth it
    closes; equal depths pair through a carry. The balance is summed per slice
    of arrival order and the slices are chained over their small totals table.
    """
    keys = [*group, name]
    cut = Window.partitionBy(*keys, "_slice").orderBy(order)
    upto = cut.rowsBetween(Window.unboundedPreceding, 0)
    step = rows.withColumns({
        "_d": F.when(is_call, 1).when(is_response, -1).otherwise(0), "_call": is_call, "_pay": payload,
        "_slice": F.floor(F.col(order) / F.lit(slice_rows))})
    step = step.withColumn("_s", F.sum("_d").over(upto)).withColumn("_m", F.min("_s").over(upto))
    totals = step.groupBy(*keys, "_slice").agg(F.sum("_d").alias("_t"), F.min("_s").alias("_p"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_s0", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    totals = totals.withColumn("_m0", F.least(F.lit(0), F.min(F.col("_s0") + F.col("_p")).over(before)))
    step = step.join(totals.drop("_t", "_p"), [*keys, "_slice"])
    low = F.least("_m0", F.col("_s0") + F.col("_m"))
    step = step.withColumn("_low", low)
    floor_before = F.coalesce(F.lag("_low").over(cut), F.col("_m0"))
    prev = F.col("_s0") + F.col("_s") - F.col("_d") - floor_before
    depth = F.when(F.col("_call"), F.col("_s0") + F.col("_s") - F.col("_low")).when(
        is_response & (prev > 0), prev)
    step = step.withColumn("_depth", F.coalesce(depth, F.lit(0)))
    found = carry(step, [*keys, "_depth"], order, {out: F.when(F.col("_call"), F.col("_pay"))},
                  inclusive=False, slice_rows=slice_rows)
    return (found.withColumn(out, F.when(is_response & (F.col("_depth") > 0), F.col(out)))
            .drop("_d", "_call", "_pay", "_slice", "_s", "_m", "_s0", "_m0", "_low", "_depth"))


def latest_open_call(rows: DataFrame, group: Sequence[str], name: str, order: str, is_call: Column, is_response: Column,
                     ident: Column, payload: Column, out: str = "matched", slice_rows: int = OPEN_SLICE, fan: int = OPEN_FAN) -> DataFrame:
    """Pair each response with the most recent unanswered call of its name; where both carry an id, the ids must be equal.

    A response always takes a fitting call of its own slice of arrival order before an older one, whatever stands further left,
    so a slice is solved by itself and leaves a summary: the responses that found no call and the calls still open, in
    order. Summaries of `fan` neighbouring slices are solved together in the same way, and so on; this is an associative merge, so
    the result does not depend on the slices. Between levels, responses before a group's first open call and calls
    behind its last open response are dropped, since nothing can pair them. `order` is a dense whole number, unique in its group.
    """
    ship(rows.sparkSession)
    keys = [*group, name]
    named = {"_h1": F.xxhash64(*keys), "_h2": F.xxhash64(F.lit("2"), *keys), "_kind": F.when(is_call, 1).when(is_response, 2).otherwise(0)}
    step = rows.withColumns(named)
    left = step.where("_kind > 0").select("_h1", "_h2", F.col(order).cast("bigint").alias("_at"), "_kind",
                                          F.when(trim_blank(ident) != "", ident).alias("_id"), payload.alias("_pay"))
    pairs, width = None, slice_rows
    while True:
        by = ["_h1", "_h2", "_slice"]
        cut = left.withColumn("_slice", F.floor(F.col("_at") / F.lit(width)))
        dealt = cut.repartition(*by).sortWithinPartitions(*by, "_at")
        solved = saved(dealt.mapInArrow(_solve_slices, dealt.schema))
        hit = solved.where("_kind = 3").select("_h1", "_h2", "_at", F.col("_pay").alias("_hit"))
        pairs = hit if pairs is None else pairs.unionByName(hit)
        rest = solved.where("_kind < 3")
        ends = rest.groupBy("_h1", "_h2").agg(F.min(F.when(F.col("_kind") == 1, F.col("_at"))).alias("_first"),
                                              F.max(F.when(F.col("_kind") == 2, F.col("_at"))).alias("_last"))
        # What is open on both sides of a border goes on; inside a slice nothing is left to pair.
        ends = ends.where((F.col("_first") < F.col("_last")) & (F.floor(F.col("_first") / F.lit(width)) < F.floor(F.col("_last") / F.lit(width))))
        left = rest.join(ends, ["_h1", "_h2"]).where("CASE WHEN _kind = 1 THEN _at < _last ELSE _at > _first END").drop("_first", "_last", "_slice")
        if ends.isEmpty():
            break
        width *= fan
    same = (step["_h1"] == pairs["_h1"]) & (step["_h2"] == pairs["_h2"]) & (step[order].cast("bigint") == pairs["_at"]) & (step["_kind"] == 2)
    return step.join(pairs, same, "left").select(*[step[c] for c in rows.columns if c != out], F.col("_hit").alias(out))


def _solve_slices(batches):
    """Rows sorted by key, slice and order: matched responses come out as kind 3 with their call's payload, the rest as it was."""
    import pyarrow as pa

    key, done, stacks, every, shape = None, [], {}, [], None

    def close():
        # Calls that were taken are marked by their kind.
        return [r for r in done if r["_kind"]]

    def latest(stack):
        while stack and not stack[-1]["_kind"]:
            stack.pop()
        return stack[-1] if stack else None

    for batch in batches:
        shape, ready = batch.schema, []
        for row in batch.to_pylist():
            now = (row["_h1"], row["_h2"], row["_slice"])
            if now != key:
                ready += close()
                key, done, stacks, every = now, [], {}, []
            done.append(row)
            if row["_kind"] == 1:
                stacks.setdefault(row["_id"], []).append(row)
                every.append(row)
                continue
            if row["_id"] is None:
                call = latest(every)
            else:
                fitting = [c for c in (latest(stacks.get(row["_id"], [])), latest(stacks.get(None, []))) if c is not None]
                call = max(fitting, key=lambda c: c["_at"], default=None)
            if call is not None:
                row["_kind"], row["_pay"], call["_kind"] = 3, call["_pay"], 0
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=shape)
    if done:
        yield pa.RecordBatch.from_pylist(close(), schema=shape)


def trim_blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def tag_nearest(results: DataFrame, failures: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Mark, for each failure record, the nearest result of the same call once.

    The latest earlier result wins; without one, the first later result.
    """
    # Both kinds on one line of time: the neighbours of a failure come from a
    # carry in each direction, never from pairing a group with itself.
    line = results.select(*keys, F.col(order).alias("_o"), F.col(order).alias("_res")).unionByName(
        failures.select(*keys, F.col(order).alias("_o"), F.lit(None).cast("bigint").alias("_res")))
    line = carry(line, keys, "_o", {"_before": F.col("_res")}, inclusive=False)
    line = carry(line, keys, "_o", {"_after": F.col("_res")}, inclusive=False, backward=True)
    picked = (line.where(F.col("_res").isNull()).select(*keys, F.coalesce("_before", "_after").alias(order))
              .where(F.col(order).isNotNull()).distinct().withColumn("failed_late", F.lit(True)))
    return (results.join(picked, [*keys, order], "left")
            .withColumn("failed_late", F.coalesce("failed_late", F.lit(False))))


def decision_links(events: DataFrame) -> DataFrame:
    """Permission decisions with the request and the result of the same call: decision_event, decided, call_event,
    result_event. A call is known by agent, session and call id; its smallest event id stands for it."""
    keys = ["source_agent", "session_id", "tool_call_id"]
    called = events.where(F.trim(F.coalesce("tool_call_id", F.lit(""))) != "")
    decided = called.where(F.col("event_type").isin("permission.approved", "permission.denied", "permission.requested"))
    first = lambda kinds: F.min(F.when(F.col("event_type").isin(*kinds), F.col("event_id")))
    sides = called.groupBy(*keys).agg(first(("command.exec", "tool.call")).alias("call_event"),
                                      first(("command.result", "tool.result")).alias("result_event"))
    return (decided.select(*keys, F.col("event_id").alias("decision_event"), F.col("event_type").alias("decided"))
            .join(sides, keys, "left").drop(*keys))


def prefer_explicit(rows: DataFrame, group: Sequence[str], explicit: Column, fallback: Column) -> DataFrame:
    """Drop fallback rows of groups that hold an explicit one."""
    # One row per group on the right; a hot group's rows stay spread, because
    # the join may split the large side.
    has = rows.groupBy(*group).agg(F.max(explicit.cast("int")).alias("_has"))
    return (rows.join(has, list(group))
            .where(~(fallback & (F.col("_has") == 1))).drop("_has"))


def from_boundary(rows: DataFrame, group: Sequence[str], boundary: Column, order: str) -> DataFrame:
    """Skip rows copied from a parent before the group's boundary row."""
    first = rows.groupBy(*group).agg(F.min(F.when(boundary, F.col(order))).alias("_b"))
    return (rows.join(first, list(group))
            .where(F.col("_b").isNull() | (F.col(order) >= F.col("_b"))).drop("_b"))
