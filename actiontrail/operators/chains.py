"""Ordered multi-event chains.

A chain ends at a final-step event and may only reach back over a bounded
number of events, so each correlation group is cut into position blocks with a
look-back margin and every block is solved on its own. Only events that match
some step travel past the numbering stage, and all rules share one exchange.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from actiontrail.functions.scalars import hash_path, parsed_instant, present
from actiontrail.operators.dedupe import first_per_id
from actiontrail.operators.positions import SLICE_ROWS, add_positions, carry
from actiontrail.schema import SEQ
from actiontrail.session import saved, ship

# Look-back bound and limits of a sequence rule.
MIN_RING = 256
MAX_WITHIN_EVENTS = 4096
MAX_MATCHES = 16
STEP_RANGE = (2, 8)
# A rule's time is cut into at most so many slices where it is the only bound.
TIME_SLICES = 250


@dataclass(frozen=True)
class ChainRule:
    rule_id: str
    steps: tuple[Column, ...] = field(compare=False)
    within_events: int | None = None
    within_seconds: float | None = None
    max_matches: int = 1

    def __post_init__(self) -> None:
        if not STEP_RANGE[0] <= len(self.steps) <= STEP_RANGE[1]:
            raise ValueError(f"{self.rule_id}: a chain has 2 to 8 steps")
        if self.within_events is None and self.within_seconds is None:
            raise ValueError(f"{self.rule_id}: a chain needs within or within_events")
        if self.within_events is not None and not (
                len(self.steps) <= self.within_events <= MAX_WITHIN_EVENTS):
            raise ValueError(f"{self.rule_id}: within_events must hold the chain "
                             f"and be at most {MAX_WITHIN_EVENTS}")
        if self.within_seconds is not None and self.within_seconds <= 0:
            raise ValueError(f"{self.rule_id}: within must be positive")
        if not 1 <= self.max_matches <= MAX_MATCHES:
            raise ValueError(f"{self.rule_id}: max_matches is 1 to {MAX_MATCHES}")


def ring_size(rules: Sequence[ChainRule], look_back: int = MIN_RING) -> int:
    """How many events of its group a chain may reach back. `look_back` is the bound of rules that only have a time."""
    return max([look_back, *[r.within_events or 0 for r in rules]])


# Columns of a completing event that its finding renders.
FINAL_COLUMNS = ("case_id", "timestamp", "source_agent", "source_type", "project_path", "session_id", "model", "model_provider",
                 "sub_agent", "event_type", "actor", "command", "file_path", "url", "mcp_server", "mcp_tool", "content_preview")


def correlation_key() -> Column:
    """16-byte group key, null for events that must not be correlated.

    Stored artifacts correlate inside one file; live events need a session.
    """
    artifact = F.col("source_type") == "artifact"
    file_part = F.when(artifact, F.sha2(F.col("evidence.local_path"), 256))
    parts = [F.col("source_agent"), F.col("source_type"),
             F.coalesce(F.col("session_id"), F.lit("")),
             F.coalesce(hash_path("project_path"), F.lit("")),
             F.coalesce(file_part, F.lit(""))]
    usable = F.when(artifact, present("evidence.local_path")).otherwise(present("session_id"))
    return F.when(usable, F.unhex(F.md5(F.concat_ws("\x00", *parts))))


def step_masks(rules: Sequence[ChainRule]) -> dict[str, Column]:
    """One bit column per rule; an erroring or null step counts as false."""
    out = {}
    for i, rule in enumerate(rules):
        bits = F.lit(0)
        for s, pred in enumerate(rule.steps):
            bits = bits + F.when(F.coalesce(pred, F.lit(False)), 1 << s).otherwise(0)
        out[f"_m{i}"] = bits
    return out


def numbered_hits(events: DataFrame, rules: Sequence[ChainRule], dedupe: bool = True,
                  slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Step-matching events with their dense position in their group."""
    masks = step_masks(rules)
    names = list(masks)
    hit = F.lit(False)
    for n in names:
        hit = hit | (F.col(n) != 0)
    link = F.struct("event_id", "evidence", "tags", "confidence")
    ends = F.lit(False)
    for name, rule in zip(names, rules, strict=True):
        ends = ends | _bit(name, len(rule.steps) - 1)
    # What a finding shows of its completing event travels with the hit.
    final = F.struct(*[c for c in FINAL_COLUMNS if c in events.columns])
    rows = (events.withColumns(masks)
            .select(correlation_key().alias("_key"), F.col(SEQ), "event_id",
                    F.unix_micros(parsed_instant("timestamp")).alias("_ts"),
                    F.when(hit, link).alias("_link"), F.when(ends, final).alias("_event"), *names)
            .where(F.col("_key").isNotNull()))
    if dedupe:
        rows = first_per_id(rows, ["_key", "event_id"], SEQ)
    rows = add_positions(rows, ["_key"], SEQ, "_pos", slice_rows)
    return rows.where(hit)


def _bit(mask: str, step: int) -> Column:
    return F.col(mask).bitwiseAND(F.lit(1 << step)) != 0


def find_chains(hits: DataFrame, rules: Sequence[ChainRule], block_rows: int | None = None,
                look_back: int = MIN_RING) -> DataFrame:
    """Chains as `(_key, rule_idx, _final, _chain)` with positions in order."""
    ring = ring_size(rules, look_back)
    block = max(block_rows or 0, 4 * ring)
    home = F.floor(F.col("_pos") / F.lit(block))
    margin = F.col("_pos") % F.lit(block) >= F.lit(block - ring)
    placed = hits.select(
        "_key", "_pos", "_ts", *[f"_m{i}" for i in range(len(rules))],
        F.explode(F.when(margin, F.array(home, home + 1)).otherwise(F.array(home))).alias("_block"))
    placed = placed.withColumn("_home", F.floor(F.col("_pos") / F.lit(block)) == F.col("_block"))

    # Tails: what greedily follows a step-k event, built from the last step
    # backwards. Descending order keeps every frame incremental.
    later = (Window.partitionBy("_key", "_block").orderBy(F.desc("_pos"))
             .rowsBetween(Window.unboundedPreceding, -1))
    deepest = max(len(r.steps) for r in rules)
    for depth in range(deepest - 1):
        layer = {}
        for i, rule in enumerate(rules):
            step = len(rule.steps) - 2 - depth
            if step < 0:
                continue
            own = F.array(F.col("_pos"))
            if depth == 0:
                layer[f"_t{i}"] = F.when(_bit(f"_m{i}", step), own)
                continue
            rest = F.last(f"_t{i}", ignorenulls=True).over(later)
            layer[f"_t{i}"] = F.when(_bit(f"_m{i}", step), F.concat(own, rest))
        placed = placed.withColumns(layer)

    found, timed = {}, []
    order = Window.partitionBy("_key", "_block").orderBy("_pos")
    for i, rule in enumerate(rules):
        reach = min(ring, (rule.within_events - 1) if rule.within_events else ring)
        frame = order.rangeBetween(-reach, -1)
        if rule.within_seconds is None:
            tail = F.first(f"_t{i}", ignorenulls=True).over(frame)
            found[f"_c{i}"] = F.when(_bit(f"_m{i}", len(rule.steps) - 1) & F.col("_home"), tail)
        else:
            timed.append((i, reach, int(rule.within_seconds * 1_000_000), 1 << (len(rule.steps) - 1)))
    solved = placed.withColumns(found)
    if timed:
        ship(hits.sparkSession)
        # A block has a bounded number of rows, and only positions, times and bits.
        shape = T.StructType([*solved.schema.fields, *[T.StructField(f"_c{i}", T.ArrayType(T.LongType())) for i, *_ in timed]])
        solved = solved.groupBy("_key", "_block").applyInArrow(_timed_tails(timed), shape)
    chains = F.array_compact(F.array(*[
        F.when(F.element_at(f"_c{i}", -1) < F.col("_pos"),
               F.struct(F.lit(i).alias("rule_idx"),
                        F.concat(F.col(f"_c{i}"), F.array("_pos")).alias("chain")))
        for i in range(len(rules))]))
    return (solved.select("_key", F.col("_pos").alias("_final"), F.explode(chains).alias("_x"))
            .select("_key", "_final", "_x.rule_idx", F.col("_x.chain").alias("_chain")))


def _timed_tails(specs: list[tuple[int, int, int, int]]):
    """Adds `_c{i}` for rules bound by events and time: the tail of the first start that both bounds allow.

    `specs`: (rule, events it reaches back, its time in microseconds, the bit of its last step).
    """
    def solve(block):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from actiontrail.operators.range_first import FirstInRange

        block = block.sort_by("_pos").combine_chunks()
        pos, stamp = block.column("_pos").to_numpy(), block.column("_ts")
        timed, home = stamp.is_valid().to_numpy(), block.column("_home").to_numpy()
        times = pc.fill_null(stamp, 0).to_numpy()
        for i, reach, span, last in specs:
            tails = block.column(f"_t{i}").combine_chunks().cast(pa.list_(pa.field("element", pa.int64())))
            starts = np.flatnonzero(tails.is_valid().to_numpy(zero_copy_only=False) & timed)
            ends = np.flatnonzero((block.column(f"_m{i}").to_numpy() & last > 0) & timed & home)
            at = np.full(len(pos), -1, np.int64)
            if len(starts) and len(ends):
                begin = np.searchsorted(pos[starts], pos[ends] - reach)
                found = FirstInRange(times[starts]).ask(begin, times[ends] - span, times[ends])
                inside = np.flatnonzero(found < len(starts))
                inside = inside[pos[starts[found[inside]]] < pos[ends[inside]]]
                at[ends[inside]] = starts[found[inside]]
            block = block.append_column(f"_c{i}", tails.take(pa.array(at, mask=at < 0)))
        return block

    return solve


def find_timed_chains(hits: DataFrame, rule: ChainRule, idx: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Chains of a rule whose only bound is its time, as `find_chains` gives them, over any number of events.

    The start is the first in order of those from the final event's time minus the rule's to the final event's own, so it depends
    on that time alone. Times are cut into slices that divide the rule's time: slices between the two ends count whole, by their
    first start; those at the ends by what stands behind or before a place in them. A busy group is spread over its slices.
    """
    span = int(rule.within_seconds * 1_000_000)
    width = max(span // math.gcd(span, TIME_SLICES), 1)
    back = span // width
    last = len(rule.steps) - 1
    rows = hits.select("_key", "_pos", "_ts", F.col(f"_m{idx}").alias("_m")).where("_m != 0")
    rows = rows.withColumn("_tail", F.when(_bit("_m", last - 1), F.array("_pos")))
    for step in range(last - 2, -1, -1):
        rows = carry(rows, ["_key"], "_pos", {"_rest": F.col("_tail")}, inclusive=False, backward=True, slice_rows=slice_rows)
        rows = rows.withColumn("_tail", F.when(_bit("_m", step), F.concat(F.array("_pos"), "_rest"))).drop("_rest")
    rows = rows.where("_ts IS NOT NULL")
    none = F.lit(None).cast("array<bigint>")
    cut = F.floor(F.col("_at") / F.lit(width))
    # Tails compare by their first position, which no other start has.
    starts = (rows.where("_tail IS NOT NULL").groupBy("_key", F.col("_ts").alias("_at")).agg(F.min("_tail").alias("_low"))
              .withColumns({"_slice": cut, "_end": F.lit(None).cast("bigint")}))
    finals = rows.where(_bit("_m", last))
    ends = finals.select("_key", F.col("_ts").alias("_end")).distinct()
    near = ends.withColumn("_at", F.col("_end"))
    far = ends.withColumn("_at", F.col("_end") - span)
    inside = Window.partitionBy("_key", "_slice").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = [starts.unionByName(side.withColumns({"_slice": cut, "_low": none}))
             .withColumn("_low", F.min("_low").over(inside.orderBy(order))).where("_end IS NOT NULL").select("_key", "_end", "_low")
             for side, order in ((near, F.asc("_at")), (far, F.desc("_at")))]
    if back > 1:
        whole = starts.groupBy("_key", "_slice").agg(F.min("_low").alias("_low"))
        between = Window.partitionBy("_key").orderBy("_slice").rangeBetween(1 - back, -1)
        asked = near.select("_key", cut.alias("_slice")).distinct()
        passed = (whole.withColumn("_ask", F.lit(False)).unionByName(asked.withColumns({"_low": none, "_ask": F.lit(True)}))
                  .withColumn("_low", F.min("_low").over(between)).where("_ask AND _low IS NOT NULL").drop("_ask"))
        found.append(near.withColumn("_slice", cut).join(passed, ["_key", "_slice"]).select("_key", "_end", "_low"))
    first = found[0]
    for other in found[1:]:
        first = first.unionByName(other)
    first = first.groupBy("_key", "_end").agg(F.min("_low").alias("_low"))
    return (finals.select("_key", "_pos", F.col("_ts").alias("_end")).join(first, ["_key", "_end"])
            .where(F.element_at("_low", -1) < F.col("_pos"))
            .select("_key", F.col("_pos").alias("_final"), F.lit(idx).alias("rule_idx"), F.concat("_low", F.array("_pos")).alias("_chain")))


def find_all_chains(hits: DataFrame, rules: Sequence[ChainRule], block_rows: int | None = None, look_back: int | None = MIN_RING,
                    slice_rows: int = SLICE_ROWS) -> DataFrame:
    """`find_chains`; without a `look_back`, rules that only have a time reach over all events inside it."""
    if look_back is not None:
        return find_chains(hits, rules, block_rows, look_back)
    counted = [i for i, r in enumerate(rules) if r.within_events is not None]
    out = [find_timed_chains(hits, r, i, slice_rows) for i, r in enumerate(rules) if r.within_events is None]
    if counted:
        some = hits.select("_key", "_pos", "_ts", *[F.col(f"_m{i}").alias(f"_m{k}") for k, i in enumerate(counted)])
        own = F.array(*[F.lit(i) for i in counted])
        out.append(find_chains(some, [rules[i] for i in counted], block_rows).withColumn("rule_idx", F.get(own, F.col("rule_idx"))))
    chains = out[0]
    for other in out[1:]:
        chains = chains.unionByName(other)
    return chains


def cap_matches(chains: DataFrame, rules: Sequence[ChainRule]) -> DataFrame:
    """Keep the first `max_matches` chains of each rule and group.

    The literal bound lets Spark drop surplus rows before the exchange.
    """
    w = Window.partitionBy("_key", "rule_idx").orderBy("_final")
    limits = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (i, r.max_matches)])
    return (chains.withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= max(r.max_matches for r in rules))
            .where(F.col("_rn") <= F.element_at(limits, F.col("rule_idx")))
            .drop("_rn"))


def chain_matches(events: DataFrame, rules: Sequence[ChainRule], dedupe: bool = True,
                  capped: bool = True, slice_rows: int = SLICE_ROWS,
                  block_rows: int | None = None, look_back: int | None = MIN_RING) -> DataFrame:
    """Matched chains: `rule_id`, ordered `links`, `final_event_id`, `final_event` (FINAL_COLUMNS).

    `look_back` bounds the events that a rule with a time alone reaches over; None sets no bound but the time.

    The step-matching events are few but cost a pass over everything, and they
    are read twice (to find chains and to cite their events), so they are saved
    once in the shared checkpoint folder.
    """
    hits = saved(numbered_hits(events, rules, dedupe, slice_rows))
    chains = find_all_chains(hits, rules, block_rows, look_back, slice_rows)
    if capped:
        chains = cap_matches(chains, rules)
    cited = chains.select("_key", "_final", "rule_idx", F.posexplode("_chain").alias("_at", "_pos"))
    links = cited.join(hits.select("_key", "_pos", "_link", "_event"), ["_key", "_pos"])
    ids = F.array(*[F.lit(r.rule_id) for r in rules])
    # A chain has at most eight links, so the list is bounded.
    return (links.groupBy("_key", "rule_idx", "_final")
            .agg(F.array_sort(F.collect_list(F.struct("_at", "_link"))).alias("_l"),
                 F.max(F.struct("_at", "_event"))["_event"].alias("final_event"))
            .select(F.element_at(ids, F.col("rule_idx") + 1).alias("rule_id"),
                    F.transform("_l", lambda x: x["_link"]).alias("links"), "final_event")
            .withColumn("final_event_id", F.element_at("links", -1)["event_id"])
            .withColumn("cited_event_ids", F.transform("links", lambda x: x["event_id"])))
