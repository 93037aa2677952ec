"""Structured Streaming forms of the pipeline.

Offsets, retries and recovery are Spark's: every query takes a checkpoint
folder, and every sink is written from `foreachBatch` or a file sink.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from actiontrail.functions.scalars import hash_path, order_key, parsed_instant, present
from actiontrail.operators import contract, findings, indicators as ind, metrics, rules as R
from actiontrail.operators.chains import ChainRule, correlation_key, ring_size, step_masks
from actiontrail.schema import SEQ
from actiontrail.sources.records import fan_out
from actiontrail.streaming.sinks import CommittedSink

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_files(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet",
               files_per_batch: int = 100) -> DataFrame:
    return (spark.readStream.format(fmt).schema(schema)
            .option("maxFilesPerTrigger", files_per_batch).load(path))


def start(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None],
          mode: str = "append", available_now: bool = True, name: str | None = None, every: str | None = None) -> StreamingQuery:
    """`every`, such as "1 minute", keeps the query running; jobs with timers need it, as they always have a batch to come."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    if name:
        w = w.queryName(name)
    if every is not None:
        return w.trigger(processingTime=every).start()
    return w.trigger(availableNow=True).start() if available_now else w.start()


Sink = Callable[[DataFrame], None] | CommittedSink


def _of_batch(sinks: Mapping[str, Sink], batch: int) -> dict[str, Callable[[DataFrame], None]]:
    """Sinks that keep a commit log are told the batch, so a repeated one changes nothing in those that had it."""
    return {name: (lambda df, s=s: s.write(df, batch)) if isinstance(s, CommittedSink) else s for name, s in sinks.items()}


def deliver(lines: DataFrame, checkpoint: str, sinks: Mapping[str, Sink],
            value: str = "value", max_bytes: int | None = None,
            oversize: Sink | None = None, size: str | None = None, **kw) -> StreamingQuery:
    """At-least-once delivery of appended records, exactly once into a `CommittedSink`. With `max_bytes`, larger records go to `oversize` instead; `size` names a
    column with their length, where the source left their content out."""
    if max_bytes is None:
        return start(lines, checkpoint, lambda df, batch: fan_out(df, _of_batch(sinks, batch)), **kw)
    if oversize is None:
        raise ValueError("a size limit needs a sink for what exceeds it")
    fits = F.coalesce((F.col(size) if size else F.octet_length(value)) <= max_bytes, F.lit(True))

    def write(df: DataFrame, batch: int) -> None:
        fan_out(df.where(fits), _of_batch(sinks, batch))
        _of_batch({"oversize": oversize}, batch)["oversize"](df.where(~fits))

    return start(lines, checkpoint, write, **kw)


# --- normalize and detect ------------------------------------------------------

def detect(events: DataFrame, rules: Sequence[R.Rule]) -> DataFrame:
    """Findings of arriving events. Stateless, so it is the batch expression."""
    good = contract.valid(events)
    return findings.from_matches(R.matches(good, rules), F.date_format(
        F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def once_per_id(events: DataFrame, clock: str, delay: str = "1 hour") -> DataFrame:
    """Drop redelivered events: equal ids inside the watermark count once."""
    return events.withWatermark(clock, delay).dropDuplicatesWithinWatermark(["event_id"])


def indicator_totals(events: DataFrame) -> DataFrame:
    """Running indicator records; run with update mode to emit changes only.

    Redelivered events count once if `once_per_id` runs before.
    """
    fields = F.filter(F.array(*[F.struct(F.lit(n == "content_preview").alias("markdown"), F.col(n).alias("text"))
                                for n in ind.FIELDS]), lambda f: f["text"] != "")
    about = F.struct("timestamp", "source_agent", "event_id", "session_id", "project_path").alias("_about")
    rows = events.select(about, F.explode(fields).alias("f")).select(
        "_about", F.col("f.text").alias("_text"), F.col("f.markdown").alias("_md"))
    mined = ind.mine_text(rows, "_text", F.col("_md"))
    seen = mined.select("_about", F.explode_outer("indicators").alias("i")).where(F.col("i").isNotNull())
    stamp = F.when(present(F.col("_about.timestamp")), order_key(F.col("_about.timestamp")))
    sums = seen.groupBy("i.type", "i.value").agg(
        F.count("*").alias("count"), F.min(stamp).alias("_lo"), F.max(stamp).alias("_hi"), F.min("_about").alias("_s"))
    return sums.select(
        "type", "value", "count", F.col("_lo.raw").alias("first_seen"), F.col("_hi.raw").alias("last_seen"),
        F.col("_s.source_agent").alias("source_agent"), F.col("_s.event_id").alias("sample_event_id"),
        F.col("_s.session_id").alias("sample_session_id"), hash_path(F.col("_s.project_path")).alias("sample_project_path_hash"))


def held_groups(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(rules, group, next position) of every group a chain stream holds, from its checkpoint; counting them is the metric of held state."""
    rows = spark.read.format("statestore").option("stateVarName", "next").load(checkpoint)
    return rows.select(F.col("key._rules").alias("rules"), F.col("key._key").alias("group"), F.col("value.pos").alias("next"))


def evicted_total(found: DataFrame) -> DataFrame:
    """The metric point of groups dropped, from the output of `stateful_chains` with `evictions`."""
    gone = found.where(F.col("rule_id").isNull())
    return gone.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("chains.groups.evicted").alias("name"), "value")


def metric_totals(points: DataFrame) -> DataFrame:
    return metrics.rollup(metrics.points(points))


# --- stateful chains -----------------------------------------------------------

def fingerprint(rules: Sequence[R.Rule]) -> str:
    """Changes with anything that would make stored step bits mean something else."""
    text = json.dumps([[r.id, r.version, r.steps, r.within, r.within_events, r.max_matches]
                       for r in rules if r.enabled and r.steps])
    return hashlib.sha256(text.encode()).hexdigest()[:16]


OUT = "rule_idx int, chain array<string>"
# Stands in the place of a rule where a group's state was dropped.
EVICTED = -1
_RING = "pos bigint, event_id string, ts bigint, mask string"


def _processor(specs: list[tuple[int, int | None, int | None, int]], ring: int, ttl_ms: int | None):
    """`specs`: (steps, within_events, within_micros, max_matches) per rule."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Chains(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.ring = handle.getListState("ring", _RING)
            self.next = handle.getValueState("next", "pos bigint")
            self.emitted = handle.getMapState("emitted", "rule int", "n int")

        def handleInputRows(self, key, rows, timerValues):
            window = [(int(r[0]), r[1], r[2], tuple(int(m) for m in r[3].split(","))) for r in self.ring.get()]
            pos = int(self.next.get()[0]) if self.next.exists() else 0
            counts = [int(self.emitted.getValue((i,))[0]) if self.emitted.containsKey((i,)) else 0
                      for i in range(len(specs))]
            ids, out = {w[1] for w in window}, []
            # Only numbers and ids are held while a key's rows are put in order.
            parts = [(p["seq"].to_numpy(), p["event_id"].to_numpy(), p["ts"].to_numpy(), p["mask"].to_numpy()) for p in rows]
            order = np.argsort(np.concatenate([p[0] for p in parts]), kind="stable")
            columns = [np.concatenate([p[k] for p in parts])[order] for k in (1, 2, 3)]
            for eid, ts, mask in zip(*columns):
                if eid in ids:
                    continue
                ts = None if pd.isna(ts) else int(ts)
                bits = tuple(int(m) for m in mask.split(","))
                for i, (steps, k, span, cap) in enumerate(specs):
                    if counts[i] < cap and bits[i] >> (steps - 1) & 1:
                        chain = _find(window[-ring:], i, steps, k, span, pos, ts)
                        if chain is not None:
                            counts[i] += 1
                            out.append((i, [*chain, eid]))
                window.append((pos, eid, ts, bits))
                ids.add(eid)
                pos += 1
                if len(window) > 2 * ring:
                    window, gone = window[-ring:], window[:-ring]
                    ids.difference_update(w[1] for w in gone)
            self.ring.put([(p, e, t, ",".join(map(str, b))) for p, e, t, b in window[-ring:]])
            self.next.update((pos,))
            for i, n in enumerate(counts):
                if n:
                    self.emitted.updateValue((i,), (n,))
            if ttl_ms is not None:
                # One timer for each group: it moves on with every batch that brings the group events.
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + ttl_ms)
            yield pd.DataFrame(out, columns=["rule_idx", "chain"]).astype({"rule_idx": "int32"})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            # The whole group goes at once, so no window is left without its count or the other way round.
            held = sum(1 for _ in self.ring.get())
            for state in (self.ring, self.next, self.emitted):
                state.clear()
            yield pd.DataFrame([(EVICTED, [str(key[-1]), str(held)])], columns=["rule_idx", "chain"]).astype({"rule_idx": "int32"})

        def close(self) -> None:
            pass

    return Chains()


def _find(window, rule, steps, k, span, pos, ts):
    """Earliest first step inside the window, then greedily the later steps."""
    chain = []
    for p, eid, t, bits in window:
        step = len(chain)
        if not bits[rule] >> step & 1:
            continue
        if step == 0:
            if k and pos - p > k - 1:
                continue
            if span is not None and (t is None or ts is None or not 0 <= ts - t <= span):
                continue
        chain.append(eid)
        if len(chain) == steps - 1:
            return chain
    return None


def stateful_chains(events: DataFrame, rules: Sequence[ChainRule], rule_set: str,
                    ttl_ms: int | None = None, evictions: bool = False) -> DataFrame:
    """Chains across micro-batches, by arrival order (`seq`) inside a group.

    Only step bits and identity are kept, at most one ring per group. `rule_set`, the
    `fingerprint` of the rules, is part of the group key, so a changed rule set starts
    with empty windows. A group that brings no event for `ttl_ms` is dropped by its timer, in the first batch after that (start such
    a query with `every`); with `evictions` a row without a rule says so: [group, events held].
    """
    ring = ring_size(rules)
    masks = step_masks(rules)
    narrow = events.select(
        F.hex(correlation_key()).alias("_key"), F.lit(rule_set).alias("_rules"), F.col(SEQ).alias("seq"), "event_id",
        F.unix_micros(parsed_instant("timestamp")).alias("ts"),
        F.concat_ws(",", *[m.cast("string") for m in masks.values()]).alias("mask"))
    narrow = narrow.where(F.col("_key").isNotNull())
    specs = [(len(r.steps), r.within_events, None if r.within_seconds is None else int(r.within_seconds * 1_000_000),
              r.max_matches) for r in rules]
    found = narrow.groupBy("_rules", "_key").transformWithStateInPandas(
        statefulProcessor=_processor(specs, ring, ttl_ms), outputStructType=OUT, outputMode="Append",
        timeMode="processingTime" if ttl_ms else "none")
    names = F.array(*[F.lit(r.rule_id) for r in rules])
    if not evictions:
        found = found.where(F.col("rule_idx") != EVICTED)
    elif ttl_ms is None:
        raise ValueError("groups are evicted only after a time")
    return found.select(F.get(names, F.col("rule_idx")).alias("rule_id"), F.col("chain").alias("cited_event_ids"))
