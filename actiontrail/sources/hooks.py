"""Hook payload rows to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from actiontrail.functions.patches import patch_changes
from actiontrail.functions.scalars import (blank_to_null, content_preview, epoch_to_rfc3339, keep_rows, mcp_parts,
                                           merge_tags, network_target_url, trim_space)
from actiontrail.schema import conform, evidence
from actiontrail.sources.otlp import decision
from actiontrail.sources.toolmap import TOOLS

# Hook event names, folded to letters, per lifecycle.
LIFECYCLES = {
    "session_start": ("sessionstart", "taskstart", "taskresume", "agentspawn", "onsessionstart", "subagentstart"),
    "session_end": ("sessionend", "taskcancel", "sessionshutdown", "onsessionend", "subagentstop", "taskcomplete"),
    "prompt": ("userpromptsubmit", "userpromptsubmitted", "beforesubmitprompt", "preuserprompt", "beforeagent"),
    "pre": ("pretooluse", "beforetool", "pretoolcall", "toolexecutebefore", "preinvocation"),
    "post": ("posttooluse", "aftertool", "posttoolcall", "toolexecuteafter", "postinvocation"),
    "post_failed": ("posttoolusefailure",),
    "command": ("beforeshellexecution", "preruncommand"),
    "command_done": ("aftershellexecution", "postruncommand"),
    "read": ("beforereadfile", "prereadcode", "postreadcode"),
    "write": ("afterfileedit", "postwritecode", "prewritecode"),
    "mcp": ("beforemcpexecution", "premcptooluse"),
    "reply": ("stop", "afteragentresponse", "agentstop", "afteragent", "postcascaderesponse"),
    "permission": ("permissionrequest", "notification", "permissionasked"),
    "denied": ("permissiondenied",),
}
# Agent -> family -> tool names, for agents without a session format.
FAMILIES = {
    "cline": {"shell": ("execute_command", "bash", "shell"),
              "read": ("read_file", "list_files", "search_files", "list_code_definition_names"),
              "write": ("write_to_file", "replace_in_file", "apply_diff", "edit_file"),
              "web": ("browser_action", "web_fetch", "web_search")},
    "amp": {"shell": ("bash", "shell_command"), "read": ("read", "finder", "grep", "glob"),
            "write": ("create_file", "edit_file", "apply_patch", "undo_edit"), "web": ("read_web_page", "web_search")},
    "auggie": {"shell": ("launch-process",), "read": ("view", "codebase-retrieval"),
               "write": ("str-replace-editor", "save-file", "remove-files"),
               "web": ("web-fetch", "web-search", "github-api", "linear")},
    "kiro": {"shell": ("execute_bash", "shell"), "read": ("fs_read", "read"), "write": ("fs_write", "write", "str_replace")},
    "goose": {"shell": ("developer__shell", "shell"), "read": ("developer__tree", "developer__read_image"),
              "write": ("developer__write", "developer__edit")},
    "kilo": {"shell": ("bash",), "read": ("read", "glob", "grep"), "write": ("edit", "write", "apply_patch"),
             "web": ("webfetch", "websearch")},
    "openhands": {"shell": ("terminal",)},
    "crush": {"shell": ("bash",), "read": ("view", "ls", "glob", "grep"), "write": ("write", "edit", "multiedit"),
              "web": ("fetch", "web_fetch", "web_search", "sourcegraph", "download")},
    "pi": {"read": ("grep", "find", "ls")},
    "codex": {"write": ("apply_patch", "create_file")}, "openclaw": {"write": ("apply_patch",)},
    "opencode": {"write": ("apply_patch",)},
}
_FAMILY_OF = {"command.exec": "shell", "file.read": "read", "file.write": "write", "file.delete": "delete",
              "network.indicator": "web"}


def family_table(spark: SparkSession) -> DataFrame:
    rows = {(agent, tool): fam for agent, fams in FAMILIES.items() for fam, tools in fams.items() for tool in tools}
    for agent, entries in TOOLS.items():
        for kind, _, _, tools in entries:
            for tool in tools:
                rows.setdefault((agent, tool.lower()), _FAMILY_OF[kind])
    for twin, source in (("vscode", "copilot"), ("qwen-code", "gemini-cli"), ("factory", "claude-code"),
                         ("grok", "claude-code"), ("devin-cli", "claude-code"), ("hermes", "claude-code")):
        rows.update({(twin, t): f for (a, t), f in list(rows.items()) if a == source})
    return spark.createDataFrame([(a, t, f) for (a, t), f in rows.items()], "_agent string, _tool string, family string")


# Objects one level down that carry looked-up fields; each is parsed once.
NESTED = ("tool_call", "toolCall", "tool_result", "tool_response", "result", "model")


def _first(doc: Column, *keys: str) -> Column:
    """First non-empty field of a document parsed to a text map."""
    def one(key: str) -> Column:
        head, _, rest = key.partition(".")
        if rest:
            return F.try_element_at(F.try_element_at(F.col("_nested"), F.lit(head)), F.lit(rest))
        if key.endswith("[0]"):
            return F.get_json_object(F.try_element_at(doc, F.lit(key[:-3])), "$[0]")
        return F.try_element_at(doc, F.lit(key))

    return F.coalesce(*[blank_to_null(one(k)) for k in keys])


def _parsed(payloads: DataFrame) -> DataFrame:
    text = "map<string,string>"
    df = payloads.withColumn("p", F.from_json("payload", text))
    inner = [(n, F.try_element_at("p", F.lit(n))) for n in NESTED]
    nested = F.map_from_arrays(
        F.array(*[F.lit(n) for n, _ in inner]),
        F.array(*[F.when(v.startswith("{"), F.from_json(v, text)) for _, v in inner]))
    return df.withColumn("_nested", nested)


def _lifecycle(event: Column) -> Column:
    folded = F.regexp_replace(F.lower(event), "[^a-z]", "")
    out: Column = F.lit(None).cast("string")
    for name, spellings in LIFECYCLES.items():
        out = F.when(folded.isin(*spellings), name).otherwise(out)
    return out


def events(payloads: DataFrame, run_id: str = "run") -> DataFrame:
    """`payloads`: seq, agent, event, payload (JSON text)."""
    p = F.col("p")
    df = _parsed(payloads)
    df = df.withColumns({
        "cycle": _lifecycle(F.coalesce(F.col("event"), _first(p, "hook_event_name", "hookEventName", "event"))),
        "source_agent": F.when((F.col("agent") == "copilot") & F.map_contains_key(p, "hook_event_name"),
                               "vscode").otherwise(F.col("agent")),
        "tool_name": _first(p, "tool_name", "toolName", "tool", "tool_call.name", "toolCall.name"),
        "input": F.coalesce(F.from_json(_first(p, "tool_input", "toolInput", "toolArgs", "tool_info", "args", "input",
                                               "tool_call.input", "toolCall.args"), "map<string,string>"), p)})
    df = df.withColumns({"_a": F.col("source_agent"), "_t": F.lower("tool_name")}).join(
        F.broadcast(family_table(df.sparkSession)), (F.col("_a") == F.col("_agent")) & (F.col("_t") == F.col("_tool")), "left")
    i, cycle, fam = F.col("input"), F.col("cycle"), F.col("family")
    either = lambda *keys: F.coalesce(_first(i, *keys), _first(p, *keys))
    post = cycle.isin("post", "post_failed")
    url = either("url", "uri")
    server, part = mcp_parts(F.col("tool_name"))
    server = F.coalesce(server, F.when(cycle == "mcp", either("server", "mcp_server", "mcp_server_name", "server_name")))
    part = F.coalesce(part, F.when(cycle == "mcp", either("mcp_tool", "mcp_tool_name", "tool_name")))
    choice = decision(either("decision", "permission_decision", "permissionDecision", "outcome"))
    tool_event = (F.when(fam == "shell", F.when(post, "command.result").otherwise("command.exec"))
                  .when(post, "tool.result").when(fam == "read", "file.read").when(fam == "write", "file.write")
                  .when(fam == "delete", "file.delete").when(fam == "web", "network.indicator").otherwise("tool.call"))
    df = df.withColumn("event_type", F.when(cycle == "session_start", "session.start").when(cycle == "session_end", "session.end")
                       .when(cycle == "prompt", "prompt.user").when(cycle == "command", "command.exec")
                       .when(cycle == "command_done", "command.result").when(cycle == "read", "file.read")
                       .when(cycle == "write", "file.write").when(cycle == "mcp", "tool.call")
                       .when(cycle == "reply", "message.assistant").when(cycle == "denied", "permission.denied")
                       .when(cycle == "permission", F.when(choice == "allowed", "permission.approved")
                             .when(choice == "denied", "permission.denied").otherwise("permission.requested"))
                       .when(cycle.isin("pre", "post", "post_failed"), tool_event))
    t = F.col("event_type")
    is_file, is_perm = t.startswith("file."), t.startswith("permission.")
    patch = F.when((F.col("tool_name") == "apply_patch") & is_file, either("command", "patch", "patchText", "patch_text", "input"))
    listed = F.coalesce(
        F.from_json(_first(i, "files", "paths"), "array<string>"),
        F.transform(F.from_json(_first(i, "files", "paths"), "array<struct<path:string,file_path:string,filePath:string>>"),
                    lambda f: F.coalesce(f["path"], f["file_path"], f["filePath"])))
    listed = F.filter(F.transform(listed, lambda x: F.when(x.startswith("{"), F.coalesce(
        F.get_json_object(x, "$.path"), F.get_json_object(x, "$.file_path"), F.get_json_object(x, "$.filePath"))).otherwise(x)),
        lambda x: trim_space(x) != "")
    single = either("file_path", "filePath", "path", "notebook_path", "target_file", "absolute_path")
    one = F.array(F.struct(single.alias("path"), (t == "file.delete").alias("delete")))
    from_patch = F.when(patch.isNotNull(), patch_changes(patch))
    # One event per distinct path; a payload without any keeps its one row.
    targets = (F.when(F.size(from_patch) > 0, from_patch)
               .when(is_file & (F.size(listed) > 0), F.transform(F.array_distinct(listed), lambda x: F.struct(
                   x.alias("path"), (t == "file.delete").alias("delete")))).otherwise(one))
    df = df.withColumns({"_targets": targets, "_patch": patch})
    df = df.withColumn("_n", F.size("_targets")).select("*", F.posexplode_outer("_targets").alias("_i", "_x"))
    kind = F.when(is_file & F.col("_patch").isNotNull(), F.when(F.col("_x.delete"), "file.delete").otherwise("file.write")).otherwise(t)
    code = either("exit_code", "exitCode", "tool_response.exit_code", "tool_response.exitCode",
                  "result.exitCode").try_cast("int")
    ms = either("duration_ms", "durationMs", "duration").try_cast("bigint")
    failed = (cycle == "post_failed") | (F.lower(either("is_error", "isError", "tool_response.is_error", "tool_response.isError")) == "true") | (
        F.lower(either("status", "tool_response.status")).isin("error", "failed")) | (F.lower(either("success")) == "false")
    ran = t.isin("command.result", "tool.result")
    stamp = _first(p, "timestamp", "time")
    n = stamp.try_cast("bigint")
    network = t == "network.indicator"
    base = F.concat(F.lit(f"hook-{run_id}-"), F.col("seq").cast("string"))
    tag = lambda cond, label: F.when(F.coalesce(cond, F.lit(False)), F.array(F.lit(label)))
    elevated = F.lower(either("permission_mode", "permissionMode")).isin("acceptedits", "auto", "bypasspermissions", "yolo")
    out = df.select(
        (F.col("seq") * 1024 + F.col("_i")).alias("seq"),
        F.when(F.col("_n") > 1, F.concat(base, F.lit("-"), (F.col("_i") + 1).cast("string"))).otherwise(base).alias("event_id"),
        "source_agent", F.lit("hook").alias("source_type"),
        F.when(n.isNull(), stamp).when(F.abs(n) >= 100_000_000_000, epoch_to_rfc3339(n, "ms")).otherwise(
            epoch_to_rfc3339(n, "s")).alias("timestamp"),
        _first(p, "cwd", "workingDirectory", "working_directory", "working_dir", "project_dir", "workspace_roots[0]",
               "workspaceRoots[0]", "workspacePaths[0]").alias("project_path"),
        _first(p, "session_key", "sessionKey", "session_id", "sessionId", "sessionID", "conversation_id", "conversationId",
               "trajectory_id", "execution_id", "taskId").alias("session_id"),
        F.when(t == "prompt.user", "user").when(t.isin("session.start", "session.end"), "system").when(ran, "tool")
        .otherwise("assistant").alias("actor"), kind.alias("event_type"),
        F.when(~t.isin("session.start", "session.end", "prompt.user", "message.assistant"), F.col("tool_name")).alias("tool_name"),
        F.when(t.startswith("command."), either("command", "commandLine", "command_line", "cmd")).alias("command"),
        F.when(is_file, F.col("_x.path")).alias("file_path"),
        F.when(is_perm, F.when(t == "permission.denied", "denied").otherwise(F.coalesce(choice, F.lit("asked")))).alias("decision"),
        F.when(~t.isin("session.start", "session.end", "prompt.user", "message.assistant"), F.coalesce(
            either("tool_use_id", "toolUseId", "tool_call_id", "toolCallId", "call_id", "callId", "callID"),
            _first(p, "tool_call.id", "tool_result.id"))).alias("tool_call_id"),
        F.when(is_file & F.col("_patch").isNotNull(), F.sha2("_patch", 256)).alias("diff_sha256"),
        F.when(is_file & F.col("_patch").isNotNull(), F.octet_length("_patch")).alias("diff_bytes"),
        F.when(t == "command.result", code).alias("exit_code"), F.when((t == "command.result") & (ms >= 0), ms).alias("duration_ms"),
        F.when(is_perm, F.lit(True)).alias("approval_required"),
        F.when(is_perm, F.when(t == "permission.denied", "denied").otherwise(F.coalesce(choice, F.lit("asked")))).alias("approval_decision"),
        F.when(is_perm, either("reason", "approval_reason", "message")).alias("approval_reason"),
        F.when(t.isin("tool.call", "tool.result", "network.indicator"), server).alias("mcp_server"),
        F.when(t.isin("tool.call", "tool.result", "network.indicator") & server.isNotNull(), part).alias("mcp_tool"),
        F.when(network, network_target_url(url)).alias("url"),
        _first(p, "model", "model_name", "modelName", "model.slug").alias("model"),
        _first(p, "model_provider", "modelProvider", "provider_name", "providerName").alias("model_provider"),
        _first(p, "git_branch", "gitBranch").alias("git_branch"),
        _first(p, "sub_agent", "subAgent", "subagent", "subagent_name", "subagentName", "subagent_type", "subagentType",
               "agent_type", "agentType", "agent_name", "agentName", "agent_id", "agentId").alias("sub_agent"),
        content_preview(F.when(t == "prompt.user", either("prompt", "user_prompt", "userPrompt", "text", "message"))
                        .when(network, F.coalesce(url, either("query", "prompt")))
                        .when(t == "message.assistant", either("assistant_text", "assistantText"))).alias("content_preview"),
        merge_tags(tag(network, "network"), tag(ran & failed, "tool_error"),
                   tag(elevated & (t == "session.start"), "permission_mode_elevated")).alias("tags"),
        F.lit("medium").alias("confidence"), evidence("hook").alias("evidence"))
    return conform(keep_rows(out, F.col("event_type").isNotNull()))
