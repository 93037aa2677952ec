"""Record schemas and closed vocabularies shared by every job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

SCHEMA_VERSION = "0.2.0"

# The closed vocabularies of the event model.
EVENT_TYPES = (
    "session.start", "session.end", "prompt.user", "message.assistant",
    "message.reasoning", "tool.call", "tool.result", "command.exec",
    "command.result", "file.read", "file.write", "file.delete",
    "permission.requested", "permission.approved", "permission.denied",
    "config.agent", "config.mcp", "network.indicator",
)
SOURCE_AGENTS = (
    "claude-code", "cowork", "codex", "gemini-cli", "cursor", "windsurf",
    "copilot", "vscode", "opencode", "openclaw", "antigravity", "factory",
    "grok", "devin-cli", "hermes", "pi", "kimi-code", "qwen-code", "cline",
    "amp", "auggie", "kiro", "goose", "kilo", "openhands", "crush", "junie",
    "unknown",
)
SOURCE_TYPES = ("artifact", "hook", "otel")
ACTORS = ("user", "assistant", "system", "tool")
DECISIONS = ("allowed", "denied", "asked")
CONFIDENCES = ("high", "medium", "low")
SEVERITIES = ("info", "low", "medium", "high", "critical")

# Which action columns each event type may fill. Columns that
# are not action columns (session context, previews, tags) are always allowed.
ACTION_COLUMNS = (
    "command", "exit_code", "duration_ms", "file_path", "diff_sha256",
    "diff_bytes", "tool_name", "tool_call_id", "mcp_server", "mcp_tool", "url",
    "decision", "approval_required", "approval_decision", "approval_reason",
)
_PERMISSION = ("tool_name", "tool_call_id", "decision", "approval_required",
               "approval_decision", "approval_reason")
ALLOWED_COLUMNS: dict[str, tuple[str, ...]] = {
    "session.start": (), "session.end": (), "prompt.user": (),
    "message.assistant": (), "message.reasoning": (), "config.agent": (),
    "tool.call": ("tool_name", "tool_call_id", "mcp_server", "mcp_tool", "url",
                  "file_path", "decision"),
    "tool.result": ("tool_name", "tool_call_id", "mcp_server", "mcp_tool", "decision"),
    "command.exec": ("command", "tool_name", "tool_call_id", "decision"),
    "command.result": ("command", "tool_name", "tool_call_id", "exit_code",
                       "duration_ms", "decision"),
    "file.read": ("file_path", "tool_name", "tool_call_id", "decision"),
    "file.write": ("file_path", "tool_name", "tool_call_id", "decision",
                   "diff_sha256", "diff_bytes"),
    "file.delete": ("file_path", "tool_name", "tool_call_id", "diff_sha256",
                    "diff_bytes"),
    "permission.requested": _PERMISSION,
    "permission.approved": _PERMISSION,
    "permission.denied": _PERMISSION,
    "config.mcp": ("mcp_server", "mcp_tool"),
    "network.indicator": ("url", "tool_name", "mcp_server", "mcp_tool",
                          "tool_call_id", "decision"),
}

EVIDENCE = T.StructType([
    T.StructField("artifact_type", T.StringType()),
    T.StructField("local_path", T.StringType()),
    T.StructField("line", T.LongType()),
    T.StructField("rowid", T.LongType()),
    T.StructField("json_pointer", T.StringType()),
    T.StructField("sha256", T.StringType()),
])

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
EVENT_FIELDS: tuple[tuple[str, T.DataType], ...] = (
    ("schema_version", _S), ("case_id", _S), ("event_id", _S),
    ("source_agent", _S), ("source_type", _S), ("timestamp", _S),
    ("project_path", _S), ("session_id", _S), ("actor", _S), ("event_type", _S),
    ("tool_name", _S), ("command", _S), ("file_path", _S), ("decision", _S),
    ("tool_call_id", _S), ("diff_sha256", _S), ("diff_bytes", _L),
    ("exit_code", _I), ("duration_ms", _L), ("approval_required", _B),
    ("approval_decision", _S), ("approval_reason", _S), ("mcp_server", _S),
    ("mcp_tool", _S), ("url", _S), ("model", _S), ("model_provider", _S),
    ("git_branch", _S), ("entrypoint", _S), ("cli_version", _S),
    ("sub_agent", _S), ("content_preview", _S),
    ("tags", T.ArrayType(_S)), ("confidence", _S), ("evidence", EVIDENCE),
)
EVENT_SCHEMA = T.StructType([T.StructField(n, t) for n, t in EVENT_FIELDS])
EVENT_COLUMNS = [n for n, _ in EVENT_FIELDS]

# `seq` is the arrival position: unique, ascending in the order a sensor saw
# the rows. It is job-internal and never published.
SEQ = "seq"


def empty_to_null(df: DataFrame) -> DataFrame:
    """Absent strings are null inside the engine, whatever the source wrote."""
    fixes = {f.name: F.nullif(F.col(f.name), F.lit(""))
             for f in df.schema.fields
             if isinstance(f.dataType, T.StringType) and f.name in EVENT_COLUMNS}
    return df.withColumns(fixes) if fixes else df


def conform(df: DataFrame) -> DataFrame:
    """Project onto the event schema: missing columns become typed nulls."""
    have = set(df.columns)
    cols: list[Column] = []
    for name, dtype in EVENT_FIELDS:
        if name == "schema_version" and name not in have:
            cols.append(F.lit(SCHEMA_VERSION).alias(name))
        elif name == "tags":
            cols.append(F.coalesce(F.col("tags"), F.array().cast(dtype)).alias("tags")
                        if name in have else F.array().cast(dtype).alias("tags"))
        elif name in have:
            cols.append(F.col(name).cast(dtype).alias(name))
        else:
            cols.append(F.lit(None).cast(dtype).alias(name))
    extra = [F.col(SEQ)] if SEQ in have else []
    return empty_to_null(df.select(*cols, *extra))


def evidence(artifact_type: Column | str, local_path: Column | None = None,
             line: Column | None = None, json_pointer: Column | None = None,
             sha256: Column | None = None, rowid: Column | None = None) -> Column:
    none = F.lit(None)
    kind = F.lit(artifact_type) if isinstance(artifact_type, str) else artifact_type
    pick = lambda c: none if c is None else c
    return F.struct(
        kind.cast("string").alias("artifact_type"),
        pick(local_path).cast("string").alias("local_path"),
        pick(line).cast("bigint").alias("line"),
        pick(rowid).cast("bigint").alias("rowid"),
        pick(json_pointer).cast("string").alias("json_pointer"),
        pick(sha256).cast("string").alias("sha256"),
    )
