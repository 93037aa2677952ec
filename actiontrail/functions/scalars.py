"""Scalar building blocks: paths, previews, ids, timestamps, tags.

Everything here is a plain ``Column`` expression, so Catalyst can prune,
fold and code-generate it; no Python worker is started.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: strict RFC 3339 shape.
RFC3339 = (r"\A[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[Tt]"
           r"([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?"
           r"([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])\z")
PREVIEW_LIMIT = 200


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind an intermediate so `body` may use it many times but it runs once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keep_rows(df: DataFrame, cond: Column) -> DataFrame:
    """Filter on a costly derived column without copying its expression.

    The optimizer moves an ordinary filter below the projections that compute
    its columns and writes their expressions out again at every use. Emitting
    zero or one row from a generator evaluates them once, in place.
    """
    row = F.when(cond, F.array(F.struct(*df.columns)))
    return df.select(F.explode(row).alias("_row")).select("_row.*")


def present(c: Column | str) -> Column:
    """True for a non-null, non-empty string."""
    return F.coalesce(col(c) != "", F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


# --- paths -----------------------------------------------------------------

def normalize_path(c: Column | str) -> Column:
    return F.translate(col(c), "\\", "/")


def clean_path(c: Column | str) -> Column:
    """Lexical path cleaning: resolve `.`/`..`, collapse separators."""
    return let(normalize_path(trim_space(col(c))), _clean)


def _clean(raw: Column) -> Column:
    rooted = raw.startswith("/")

    def step(acc: Column, part: Column) -> Column:
        top = F.try_element_at(acc, F.lit(-1))
        climb = (F.when((F.size(acc) > 0) & (top != ".."),
                        F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                 .when(rooted, acc)
                 .otherwise(F.array_append(acc, F.lit(".."))))
        return (F.when((part == "") | (part == "."), acc)
                .when(part == "..", climb)
                .otherwise(F.array_append(acc, part)))

    parts = F.aggregate(F.split(raw, "/"), F.array().cast("array<string>"), step)
    joined = F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")),
                      F.array_join(parts, "/"))
    return F.when(raw == "", F.lit("")).otherwise(
        let(joined, lambda j: F.when(j == "", F.lit(".")).otherwise(j)))


def hash_path(c: Column | str) -> Column:
    """`sha256:` digest of the cleaned path; empty or null stays null."""
    raw = col(c)
    # The lexical walk is interpreted, so already-clean paths skip it.
    messy = raw.rlike(r"(?U)\\|//|(\A|/)\.\.?(/|\z)|./\z|\A\s|\s\z")
    cleaned = F.when(messy, clean_path(raw)).otherwise(raw)
    return let(cleaned, lambda p: F.when(p != "", F.concat(F.lit("sha256:"), F.sha2(p, 256))))


# --- text ------------------------------------------------------------------

def content_preview(c: Column | str, limit: int = PREVIEW_LIMIT) -> Column:
    """Collapse whitespace and keep whole tokens within `limit` characters."""
    flat = trim_space(F.regexp_replace(col(c), r"(?U)\s+", " "))
    head = F.substring(flat, 1, limit + 1)
    cut = F.regexp_extract(head, r"(?s)\A(.*) ", 1)
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def mcp_parts(c: Column | str) -> tuple[Column, Column]:
    """Server and tool of an `mcp__server__tool` name, null when not one."""
    shape = r"(?s)\Amcp__(.+?)__(.+)\z"
    return (blank_to_null(F.regexp_extract(col(c), shape, 1)),
            blank_to_null(F.regexp_extract(col(c), shape, 2)))


def network_target_url(c: Column | str) -> Column:
    """The trimmed text when it is an absolute http(s) URL with a host."""
    text = trim_space(col(c))
    ok = text.rlike(r"(?i)\Ahttps?://([^/?#@\s]*@)?(\[[0-9a-f:.%]+\]|[^/?#@:\s\[\]]+)(:[0-9]*)?([/?#]|\z)")
    bad = text.rlike(r"[\x00-\x1f\x7f]|%(?![0-9A-Fa-f]{2})")
    return F.when(ok & ~bad, text)


def first_url(c: Column | str) -> Column:
    token = F.regexp_extract(col(c), r"(?U)(?:\A|\s)(https?://\S*)", 1)
    return blank_to_null(F.regexp_replace(token, r"[.,;)\]}\"']+\z", ""))


# --- tags ------------------------------------------------------------------

def merge_tags(*sets: Column | str) -> Column:
    arrays = [F.coalesce(col(s), F.array().cast("array<string>")) for s in sets]
    flat = F.concat(*arrays) if len(arrays) > 1 else arrays[0]
    return F.array_sort(F.array_distinct(F.filter(flat, lambda t: t != "")))


# --- timestamps ------------------------------------------------------------

def parsed_instant(c: Column | str) -> Column:
    """Microsecond instant of an RFC 3339 text, null otherwise."""
    raw = col(c)
    shape = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"
    return F.when(raw.rlike(shape),
                  F.try_to_timestamp(F.regexp_replace(F.regexp_replace(raw, ",", "."),
                                                      r"(\.[0-9]{6})[0-9]+", "$1")))


def order_key(c: Column | str) -> Column:
    """Total order over timestamp texts: absent, then instants, then junk.

    Spark timestamps stop at microseconds, so the sub-microsecond digits are a
    separate field before the raw text breaks the remaining ties.
    """
    raw = F.coalesce(col(c), F.lit(""))
    instant = parsed_instant(raw)
    nanos = F.rpad(F.regexp_extract(raw, r"[.,][0-9]{6}([0-9]{1,3})", 1), 3, "0")
    return F.struct(
        F.when(raw == "", 0).when(instant.isNotNull(), 1).otherwise(2).alias("class"),
        instant.alias("instant"),
        F.when(instant.isNotNull(), nanos).alias("nanos"),
        raw.alias("raw"),
    )


def activity_timestamp(c: Column | str) -> Column:
    raw = col(c)
    return F.when(raw.rlike(RFC3339) & parsed_instant(F.upper(raw)).isNotNull(), raw)


def epoch_to_rfc3339(c: Column | str, unit: str) -> Column:
    """Epoch count to UTC text; non-positive is absent. Units: s, ms, us, ns."""
    n = col(c).cast("bigint")
    micros = {"s": n * 1_000_000, "ms": n * 1_000, "us": n,
              "ns": F.floor(n / 1_000).cast("bigint")}[unit]
    if unit == "ns":
        micros = (n - F.pmod(n, F.lit(1_000))) / F.lit(1_000)
        micros = micros.cast("bigint")
        frac = F.lpad(F.pmod(n, F.lit(1_000_000_000)).cast("string"), 9, "0")
    else:
        frac = F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0")
    seconds = F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss")
    tail = F.regexp_replace(frac, "0+$", "")
    return F.when(n > 0, F.concat(seconds, F.when(tail != "", F.concat(F.lit("."), tail))
                                  .otherwise(F.lit("")), F.lit("Z")))


# --- identity --------------------------------------------------------------

def _sized(c: Column) -> Column:
    raw = F.encode(c, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw)), 16, "0")), raw)


def finding_id(rule_id: Column, rule_version: Column, event_ids: Column) -> Column:
    """Stable id over rule revision and the ordered contributing event ids."""
    head = F.concat(_sized(rule_id), _sized(rule_version))
    body = F.aggregate(event_ids, head, lambda acc, e: F.concat(acc, _sized(e)))
    return F.concat(F.lit("fnd-"), F.substring(F.sha2(body, 256), 1, 24))


def decision_id(run_id: Column, event_ids: Column) -> Column:
    joined = F.concat(run_id, F.concat_ws("", F.transform(
        event_ids, lambda e: F.concat(F.lit("\x00"), e))))
    return F.concat(F.lit("enf-"), F.substring(F.sha2(joined, 256), 1, 24))


def derived_event_id(prefix: str, *parts: Column) -> Column:
    """Deterministic id from source coordinates, so a re-read gives the same id."""
    joined = F.concat_ws("\x00", *[p.cast("string") for p in parts])
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(joined, 256), 1, 32))


def any_of(c: Column, values: Sequence[str]) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


# --- timeline labels -------------------------------------------------------

def step_detail() -> Column:
    """The column that says what happened, chosen by event type."""
    kind = F.col("event_type")
    pick = (F.when(kind.isin("session.start", "session.end") & present("sub_agent"),
                   F.concat(F.lit("subagent: "), F.col("sub_agent")))
            .when(kind.startswith("command."), blank_to_null(F.col("command")))
            .when(kind.startswith("file."), blank_to_null(F.col("file_path")))
            .when(kind == "network.indicator", blank_to_null(F.col("url")))
            .when(kind.startswith("tool."), blank_to_null(F.col("tool_name")))
            .when(kind == "config.agent", blank_to_null(F.col("sub_agent"))))
    return F.coalesce(pick, blank_to_null(F.col("content_preview")), F.lit("-"))


def evidence_ref() -> Column:
    path = F.coalesce(F.col("evidence.local_path"), F.lit(""))
    return (F.when(F.col("evidence.line") > 0,
                   F.concat(path, F.lit(":"), F.col("evidence.line").cast("string")))
            .when(present("evidence.json_pointer"), F.concat(path, F.col("evidence.json_pointer")))
            .otherwise(path))


def patch_digest(c: Column | str) -> tuple[Column, Column]:
    raw = blank_to_null(col(c))
    return F.sha2(raw, 256), F.octet_length(raw).cast("bigint")
