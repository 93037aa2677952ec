"""What every session-log job shares: moments, pairing, identity, evidence.

A job turns a line into an array of *moments* with one struct type. The rest
is common: calls are classified by the tool table, results are promoted when
an earlier call of their id ran a command, previews and ids are derived.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from actiontrail.functions.scalars import content_preview
from actiontrail.schema import conform, evidence
from actiontrail.sources.toolmap import classify_calls

LINE_STEP = 4096

FIELDS = {
    "block": "bigint", "kind": "string", "event_type": "string", "actor": "string", "tool": "string",
    "call_id": "string", "args": "string", "text": "string", "url": "string", "command": "string",
    "file_path": "string", "exit_code": "int", "duration_ms": "bigint", "is_error": "boolean",
    "pointer": "string", "confidence": "string", "tags": "array<string>", "sub_agent": "string",
    "mcp_server": "string", "mcp_tool": "string", "diff_sha256": "string", "diff_bytes": "bigint",
    "decision": "string", "event_time": "string", "own_id": "string",
}


def moment(**values: Column | str | int | None) -> Column:
    unknown = set(values) - set(FIELDS)
    if unknown:
        raise ValueError(f"unknown moment fields {sorted(unknown)}")
    base = {"block": F.lit(0), "confidence": F.lit("high"), **values}
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*[col(base.get(n)).cast(t).alias(n) for n, t in FIELDS.items()])


def no_moments() -> Column:
    return F.array().cast("array<struct<" + ",".join(f"{n}:{t}" for n, t in FIELDS.items()) + ">>")


def explode_moments(rows: DataFrame, column: str = "moments") -> DataFrame:
    keep = [c for c in rows.columns if c != column]
    out = rows.select(*keep, F.explode_outer(column).alias("_m")).where(F.col("_m").isNotNull())
    return out.select(*[c for c in keep if c not in FIELDS], "_m.*")


def path_id(prefix: str, *parts: Column, sep: str = ":") -> Column:
    joined = F.concat_ws(sep, *[p.cast("string") for p in parts])
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(joined, 256), 1, 16))


def promote_results(df: DataFrame, consume: bool = False) -> DataFrame:
    """A result whose id was an earlier command call becomes command.result.

    The newest earlier call owns a reused id; with `consume` only the first
    result after the call is promoted. Rows without an id stay out of the
    window's exchange partitioning by taking their own line as key.
    """
    key = F.coalesce("call_id", F.concat(F.lit("\x00"), F.col("line").cast("string")))
    w = (Window.partitionBy("local_path", "_ck").orderBy("line", "block")
         .rowsBetween(Window.unboundedPreceding, -1))
    mark = F.when(F.col("kind") == "call", F.struct(
        (F.col("event_type") == "command.exec").alias("cmd"), F.col("tool").alias("tool"),
        F.col("line").alias("line"), F.col("block").alias("block")))
    out = df.withColumn("_ck", key).withColumn("_own", F.last(mark, ignorenulls=True).over(w))
    first = F.lit(True)
    if consume:
        since = (Window.partitionBy("local_path", "_ck", "_own.line", "_own.block", "kind")
                 .orderBy("line", "block"))
        out = out.withColumn("_nth", F.row_number().over(since))
        first = F.col("_nth") == 1
    is_result = F.col("kind") == "result"
    owned = is_result & F.col("call_id").isNotNull() & F.coalesce(F.col("_own.cmd"), F.lit(False)) & first
    out = out.withColumns({
        "event_type": F.when(owned, "command.result").when(
            is_result, F.coalesce("event_type", F.lit("tool.result"))).otherwise(F.col("event_type")),
        "owner_tool": F.when(is_result, F.col("_own.tool"))})
    return out.drop("_ck", "_own", "_nth")


def single_outcome(df: DataFrame) -> DataFrame:
    """Exit code and duration belong to a line's only command result."""
    w = Window.partitionBy("local_path", "line")
    n = F.sum(F.when(F.col("event_type") == "command.result", 1).otherwise(0)).over(w)
    ok = (F.col("event_type") == "command.result") & (F.col("_n") == 1)
    return df.withColumn("_n", n).withColumns({
        "exit_code": F.when(ok, F.col("exit_code")),
        "duration_ms": F.when(ok, F.col("duration_ms"))}).drop("_n")


def finish(df: DataFrame, agent: str, artifact_type: str, ident: Callable[[], Column],
           case_id: str | None = None, full: bool = False, line_step: int = LINE_STEP) -> DataFrame:
    """Moments to events. `df` carries local_path, line, sha256, timestamp,
    session_id, project_path besides the moment fields. A line holds fewer than `line_step` of them."""
    none = F.array().cast("array<string>")
    errors = F.when(F.coalesce("is_error", F.lit(False)), F.array(F.lit("tool_error"))).otherwise(none)
    cmd_result = F.col("event_type") == "command.result"
    have = set(df.columns)
    opt = lambda n, t="string": F.col(n) if n in have else F.lit(None).cast(t)
    out = df.select(
        F.lit(case_id).cast("string").alias("case_id"),
        F.coalesce("own_id", ident()).alias("event_id"), F.lit(agent).alias("source_agent"),
        F.lit("artifact").alias("source_type"),
        F.coalesce("event_time", "timestamp").alias("timestamp"), "project_path", "session_id", "actor",
        "event_type", F.col("tool").alias("tool_name"), "command", "file_path", "decision",
        F.col("call_id").alias("tool_call_id"), "diff_sha256", "diff_bytes",
        F.when(cmd_result, F.col("exit_code")).alias("exit_code"),
        F.when(cmd_result, F.col("duration_ms")).alias("duration_ms"),
        "mcp_server", "mcp_tool", "url",
        opt("model").alias("model"), opt("model_provider").alias("model_provider"),
        opt("git_branch").alias("git_branch"), opt("cli_version").alias("cli_version"), "sub_agent",
        content_preview("text").alias("content_preview"),
        F.concat(F.coalesce("tags", none), errors).alias("tags"), "confidence",
        evidence(artifact_type, F.col("local_path"), F.col("line"), F.col("pointer"), F.col("sha256")).alias("evidence"),
        F.col("line"), F.col("block"))
    out = out.withColumn("seq", F.col("line") * line_step + F.col("block"))
    if not full:
        out = out.where(F.col("event_type") != "message.reasoning").withColumns({
            "model": F.lit(None).cast("string"), "model_provider": F.lit(None).cast("string")})
    return conform(out)


def lifecycle(start: DataFrame, end: DataFrame, make: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    return make(start, "session.start").unionByName(make(end, "session.end"))


def parse(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Typed entries `e` and diagnostics for lines that are not JSON objects."""
    rows = lines.where(F.trim("raw") != "").withColumn("e", F.from_json(
        "raw", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("e").isNull() | F.col("e._bad").isNotNull()
    notes = rows.where(bad).select(F.col("local_path").alias("path"), "line",
                                   F.lit("malformed JSON line").alias("message"))
    return rows.where(~bad), notes


def classified(df: DataFrame, agent: str) -> DataFrame:
    return classify_calls(df.withColumn("_ag", F.lit(agent)), "_ag", "tool", "args").drop("_ag")
