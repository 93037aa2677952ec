"""One table that gives every known tool its event type and argument keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from actiontrail.functions.scalars import content_preview, first_url, mcp_parts, network_target_url

# Agents whose tool names are compared without case.
CASELESS = ("cursor", "windsurf")
# Argument keys under which tools pass paths, commands, URLs and searches.
_FILE = ("file_path", "filePath", "path", "target_file")
_CMD = ("command", "commandLine", "command_line", "cmd")
_URL = ("url", "uri", "link")
_QUERY = ("query", "search_term", "q")
# Agent -> (event type, what the argument is, argument keys, tool names).
TOOLS: dict[str, tuple[tuple[str, str, tuple[str, ...], tuple[str, ...]], ...]] = {
    "claude-code": (
        ("command.exec", "command", ("command",), ("Bash",)),
        ("file.read", "path", ("file_path", "notebook_path"), ("Read", "NotebookRead")),
        ("file.write", "path", ("file_path", "notebook_path"),
         ("Write", "Edit", "MultiEdit", "NotebookEdit", "Update")),
        ("network.indicator", "url", ("url",), ("WebFetch", "mcp__fetch__fetch")),
        ("network.indicator", "text", ("query",), ("WebSearch",))),
    "codex": (
        ("command.exec", "command", ("command", "cmd"), ("shell", "shell_command", "exec_command", "local_shell")),
        ("file.read", "path", ("path",), ("read_file",)),
        ("file.write", "path", ("path",), ("write_file", "edit_file")),
        ("network.indicator", "url", ("url",), ("mcp__fetch__fetch",))),
    "cursor": (
        ("command.exec", "command", _CMD, ("shell", "run_terminal_cmd", "terminal", "bash", "runcommand")),
        ("file.read", "path", _FILE, ("read", "read_file", "readfile")),
        ("file.write", "path", _FILE, ("write", "write_file", "create_file", "createfile", "edit", "edit_file",
                                       "editfile", "search_replace", "apply_patch", "multiedit")),
        ("file.delete", "path", _FILE, ("delete", "delete_file", "deletefile")),
        ("network.indicator", "text", _QUERY, ("web_search", "websearch", "search_web")),
        ("network.indicator", "url", _URL, ("web_fetch", "webfetch", "fetch", "fetch_url", "read_url",
                                            "mcp__fetch__fetch"))),
    "windsurf": (
        ("command.exec", "command", _CMD, ("run_command", "runcommand", "run_terminal_cmd", "shell", "terminal",
                                           "bash", "command")),
        ("file.read", "path", (*_FILE, "absolute_path"), ("read_code", "readcode", "read", "read_file", "readfile",
                                                          "view_file", "viewfile")),
        ("file.write", "path", (*_FILE, "absolute_path"),
         ("write_code", "writecode", "write", "write_file", "create_file", "createfile", "write_to_file",
          "edit_code", "editcode", "edit", "edit_file", "editfile", "replace_file_content", "search_replace",
          "apply_patch", "multiedit")),
        ("file.delete", "path", (*_FILE, "absolute_path"), ("delete_file", "deletefile", "delete")),
        ("network.indicator", "text", _QUERY, ("search_web", "web_search", "websearch")),
        ("network.indicator", "url", _URL, ("read_url_content", "read_url", "web_fetch", "webfetch", "fetch",
                                            "fetch_url", "mcp__fetch__fetch"))),
    "copilot": (
        ("command.exec", "command", ("command", "cmd"), ("ShellCommand", "run_shell_command", "Bash")),
        ("file.read", "path", ("path", "filePath", "file_path"), ("ReadFile", "read_file", "Read")),
        ("file.write", "path", ("path", "filePath", "file_path"),
         ("WriteFile", "write_file", "EditFile", "Write", "Edit")),
        ("network.indicator", "url", ("url", "query"), ("WebFetch", "web_fetch", "WebSearch"))),
    "gemini-cli": (
        ("command.exec", "command", ("command",), ("run_shell_command",)),
        ("file.read", "path", ("file_path",), ("read_file",)),
        ("file.write", "path", ("file_path",), ("write_file", "replace")),
        ("network.indicator", "url_in_text", ("prompt",), ("web_fetch",)),
        ("network.indicator", "text", ("query",), ("google_web_search",))),
    "opencode": (
        ("command.exec", "command", ("command",), ("bash",)),
        ("file.read", "path", ("filePath",), ("read",)),
        ("file.write", "path", ("filePath",), ("write", "edit")),
        ("network.indicator", "url", ("url",), ("webfetch",)),
        ("network.indicator", "text", ("query",), ("websearch",))),
    "openclaw": (
        ("command.exec", "command", ("command",), ("Bash", "shell", "exec")),
        ("file.read", "path", ("file_path", "path"), ("FileRead", "Read", "read")),
        ("file.write", "path", ("file_path", "path"), ("FileWrite", "FileEdit", "Write", "Edit", "write", "edit")),
        ("network.indicator", "text", ("query",), ("WebSearch", "web_search")),
        ("network.indicator", "url", ("targetUrl", "url", "query"), ("browser",)),
        ("network.indicator", "url", ("url",), ("WebFetch", "web_fetch"))),
    "pi": (
        ("command.exec", "command", ("command",), ("bash",)),
        ("file.read", "path", ("path",), ("read",)),
        ("file.write", "path", ("path",), ("write", "edit"))),
    "kimi-code": (
        ("command.exec", "command", ("command",), ("Bash",)),
        ("file.read", "path", ("path",), ("Read",)),
        ("file.write", "path", ("path",), ("Write", "Edit")),
        ("network.indicator", "url", ("url",), ("FetchURL",))),
}
# Agents that reuse another agent's tool names.
SAME_TOOLS = {"cowork": "claude-code", "qwen-code": "gemini-cli", "vscode": "copilot"}
_SCHEMA = "_agent string, _tool string, _type string, _role string, _keys array<string>"


def tool_table(spark: SparkSession) -> DataFrame:
    rows = []
    for agent, entries in [*TOOLS.items(), *[(a, TOOLS[b]) for a, b in SAME_TOOLS.items()]]:
        rows += [(agent, tool, kind, role, list(keys))
                 for kind, role, keys, tools in entries for tool in tools]
    return spark.createDataFrame(rows, _SCHEMA)


def tool_key(agent: Column, tool: Column) -> Column:
    return F.when(agent.isin(*CASELESS), F.lower(tool)).otherwise(tool)


def classify_calls(df: DataFrame, agent: str, tool: str, args: str) -> DataFrame:
    """Fill event_type, command, file_path, url, preview, tags of call rows.

    `args` is a JSON object text. Rows whose `kind` is not `call` keep their
    values. The table has a fixed size, so it is broadcast.
    """
    joined = df.withColumn("_a", F.col(agent)).withColumn("_tk", tool_key(F.col(agent), F.col(tool))).join(
        F.broadcast(tool_table(df.sparkSession)),
        (F.col("_a") == F.col("_agent")) & (F.col("_tk") == F.col("_tool")) & (F.col("kind") == "call"), "left")
    values = F.from_json(F.col(args), "map<string,string>")
    joined = joined.withColumn("_v", F.when(F.col("_keys").isNotNull(), values))
    value = F.get(F.filter(F.transform("_keys", lambda k: F.try_element_at(F.col("_v"), k)),
                           lambda v: F.coalesce(v != "", F.lit(False))), F.lit(0))
    joined = joined.withColumn("_arg", value)
    call, role = F.col("kind") == "call", F.col("_role")
    server, tool_part = mcp_parts(tool)
    net = F.col("_type") == "network.indicator"
    url = F.when(role == "url", network_target_url("_arg")).when(
        role == "url_in_text", network_target_url(first_url("_arg")))
    none = F.array().cast("array<string>")
    return joined.withColumns({
        "event_type": F.when(call, F.coalesce("_type", F.lit("tool.call"))).otherwise(F.col("event_type")),
        "command": F.when(call & (role == "command"), F.col("_arg")).otherwise(F.col("command")),
        "file_path": F.when(call & (role == "path"), F.col("_arg")).otherwise(F.col("file_path")),
        "url": F.when(call & net, url).otherwise(F.col("url")),
        "text": F.when(call & net, F.col("_arg")).otherwise(F.col("text")),
        "tags": F.concat(F.coalesce("tags", none), F.when(call & net, F.array(F.lit("network"))).otherwise(none)),
        "mcp_server": F.when(F.col("event_type").isNull() & (call & (F.col("_type").isNull() | net)), server)
        .otherwise(F.col("mcp_server")),
        "mcp_tool": F.when(F.col("event_type").isNull() & (call & (F.col("_type").isNull() | net)), tool_part)
        .otherwise(F.col("mcp_tool")),
    }).drop("_a", "_tk", "_agent", "_tool", "_type", "_role", "_keys", "_v", "_arg")


def previewed(df: DataFrame) -> DataFrame:
    return df.withColumn("content_preview", content_preview("text"))
