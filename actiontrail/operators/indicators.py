"""Indicator mining and folding.

Only rows that can hold an indicator reach the regular expressions; each
observed value is exploded once per event field and folded by a two-phase
aggregate, so a value seen in a third of all rows costs one partial row per
task rather than one hot reducer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from actiontrail.functions import hosts
from actiontrail.functions.redact import STAGES, Stage, redact_columns
from actiontrail.functions.scalars import hash_path, order_key, present
from actiontrail.schema import SEQ
from actiontrail.session import saved

# Mined in this order; previews may carry Markdown.
FIELDS = ("url", "command", "content_preview")


@dataclass(frozen=True)
class Limits:
    """Optional caps. The default keeps every indicator."""

    per_field: int | None = None
    value_bytes: int | None = None


def mine_text(df: DataFrame, text: str, markdown: Column | None = None,
              limits: Limits = Limits(), stages: tuple[Stage, ...] = STAGES) -> DataFrame:
    """Add `indicators: array<struct<type,value>>` and `truncated` for a text column, mined after redaction by `stages`."""
    df = df.where(F.col(text).rlike(hosts._ANY_DEFANGED + "|" + hosts.CANDIDATE))
    df = redact_columns(df, {"_t": text}, stages)
    df = df.withColumn("_t", hosts.refang(F.col("_t")))
    if markdown is not None:
        df = df.withColumn("_t", F.when(markdown, hosts.strip_bold(F.col("_t"))).otherwise(F.col("_t")))
    df = df.withColumn("_b", hosts.blank_urls(F.col("_t")))
    found = F.array_distinct(F.concat(hosts.url_indicators(F.col("_t")), hosts.bare_indicators(F.col("_b"))))
    # A generator: otherwise each later use of the column, a filter too, is a copy of all stages in the plan.
    df = df.select("*", F.explode_outer(F.array(F.struct(found.alias("all")))).alias("_m"))
    df = df.withColumn("indicators", F.col("_m.all")).drop("_m")
    truncated: Column = F.lit(False)
    if limits.value_bytes is not None:
        short = F.filter("indicators", lambda i: F.octet_length(i["value"]) <= limits.value_bytes)
        df = df.withColumn("_short", short)
        truncated = truncated | (F.size("_short") < F.size("indicators"))
        df = df.withColumn("truncated", truncated).withColumn("indicators", F.col("_short")).drop("_short")
        truncated = F.col("truncated")
    if limits.per_field is not None:
        truncated = truncated | (F.size("indicators") > limits.per_field)
        df = df.withColumn("truncated", truncated).withColumn(
            "indicators", F.slice("indicators", 1, limits.per_field))
        truncated = F.col("truncated")
    return df.withColumn("truncated", truncated).drop("_t", "_b")


def observations(events: DataFrame, limits: Limits = Limits(), stages: tuple[Stage, ...] = STAGES) -> DataFrame:
    """One row per distinct (event, field, type, value) of first event copies."""
    fields = F.filter(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.col(name).alias("text"),
                 F.lit(name == "content_preview").alias("markdown"))
        for i, name in enumerate(FIELDS)]), lambda f: f["text"] != "")
    rows = events.select(
        "event_id", "source_agent", "session_id", "project_path", "timestamp", SEQ, arrival().alias("_arrival"),
        F.explode(fields).alias("field"))
    mined = mine_text(rows.withColumn("_text", F.col("field.text")), "_text",
                      F.col("field.markdown"), limits, stages)
    found = mined.select(
        "event_id", "source_agent", "session_id", "project_path", "timestamp", SEQ, "_arrival",
        F.col("field.pos").alias("pos"), "truncated",
        F.explode_outer("indicators").alias("i")).where(F.col("i").isNotNull()).select(
            "*", "i.type", "i.value").drop("i")
    return first_copies(found, events)


def arrival() -> Column:
    """An order of arrival that holds across files."""
    return F.struct(F.col(SEQ).alias("seq"), F.coalesce(F.col("evidence.local_path"), F.lit("")).alias("path"),
                    F.coalesce(F.col("evidence.line"), F.lit(-1)).cast("bigint").alias("line"))


def first_copies(found: DataFrame, events: DataFrame) -> DataFrame:
    """Keep observations of the first event of each id.

    Texts are mined where they lie; only ids and positions are shuffled to find
    the first copy, never the texts. Rows without an id all count.
    """
    # Positions are counted per file, so the same record under two paths ties; path and line decide then.
    first = events.where(present("event_id")).groupBy("event_id").agg(F.min(arrival()).alias("_first"))
    return (found.join(first, "event_id", "left")
            .where(F.col("_first").isNull() | (F.col("_first") == F.col("_arrival"))).drop("_first"))


def fold(obs: DataFrame) -> DataFrame:
    """Deduplicate observations into one record per (type, value)."""
    stamp = F.when(present("timestamp"), order_key("timestamp"))
    sample = F.struct(SEQ, "pos", "source_agent", "event_id", "session_id", "project_path")
    out = obs.withColumn("_k", stamp).withColumn("_s", sample).groupBy("type", "value").agg(
        F.count("*").alias("count"),
        F.min("_k").alias("_lo"), F.max("_k").alias("_hi"), F.min("_s").alias("_s"))
    return out.select(
        "type", "value", "count",
        F.col("_lo.raw").alias("first_seen"), F.col("_hi.raw").alias("last_seen"),
        F.col("_s.source_agent").alias("source_agent"),
        F.col("_s.event_id").alias("sample_event_id"),
        F.col("_s.session_id").alias("sample_session_id"),
        hash_path("_s.project_path").alias("sample_project_path_hash"))


def indicators(events: DataFrame, limits: Limits = Limits(), stages: tuple[Stage, ...] = STAGES) -> DataFrame:
    return fold(observations(events, limits, stages))


# Bins of one look at where the last kept key may lie.
BINS = 1024


def first_seen_keys(obs: DataFrame) -> DataFrame:
    """(type, value) with where each was seen first: arrival number, a number for its place in the artifacts, field."""
    # Positions are counted per file, so events of several files may share one; a hash of path and line decides then.
    place = F.shiftrightunsigned(F.xxhash64("_arrival.path", "_arrival.line"), 1)
    return obs.groupBy("type", "value").agg(F.min(F.struct(F.col(SEQ).cast("bigint").alias("seq"), place.alias("place"), F.col("pos").alias("pos"))).alias("_f")).select(
        "type", "value", "_f.*")


def earliest_keys(keys: DataFrame, limit: int, bins: int = BINS) -> DataFrame:
    """The `limit` keys that were seen first, exactly; keys of one field of one event by type and value.

    The place of the last kept key is found by counting keys in bins of arrival, then again inside the one bin where it lies, and so on: a few
    passes that return at most `bins` numbers each. Only keys of one single place are ever put in order, which an event's field bounds.
    """
    number, rest, need, kept = ["seq", "place"], keys, limit, F.lit(False)
    inside = F.lit(True)
    for c in number:
        low, high = rest.agg(F.min(c), F.max(c)).first()
        if low is None:
            break
        while low < high:
            width = -(-(high - low + 1) // bins)
            at = F.expr(f"({c} - {low}L) div {width}L")
            counts = {r["b"]: r["n"] for r in rest.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
            bin_, before = None, 0
            for b in sorted(counts):
                if before + counts[b] > need:
                    bin_ = b
                    break
                before += counts[b]
            if bin_ is None:
                return keys.where(kept | inside)
            begin = low + bin_ * width
            kept, need = kept | (inside & (F.col(c) < begin)), need - before
            low, high = begin, min(begin + width - 1, high)
            inside = inside & F.col(c).between(low, high)
            rest = keys.where(inside)
    order = Window.partitionBy("seq", "place").orderBy("pos", "type", "value")
    last = rest.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= need).drop("_nth")
    return keys.where(kept).unionByName(last)


def capped_indicators(events: DataFrame, limit: int, limits: Limits = Limits(),
                      stages: tuple[Stage, ...] = STAGES) -> tuple[DataFrame, int]:
    """(records of the first `limit` keys of a run, how many keys were left out). A number above 0 makes a summary `partial`."""
    obs = observations(events, limits, stages)
    keys = saved(first_seen_keys(obs))
    total = keys.count()
    if total <= limit:
        return fold(obs), 0
    kept = saved(earliest_keys(keys, limit)).select("type", "value")
    return fold(obs.join(kept, ["type", "value"], "left_semi")), total - limit


def in_order(records: DataFrame) -> DataFrame:
    """Records by type, then value: the order of an indicator export."""
    return records.orderBy("type", "value")
