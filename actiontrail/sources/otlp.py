"""Telemetry log records to events, and metric points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from actiontrail.functions.scalars import (blank_to_null, content_preview, epoch_to_rfc3339, keep_rows, mcp_parts,
                                           merge_tags, network_target_url, trim_space)
from actiontrail.schema import conform, evidence

_VALUE = ("struct<stringValue:string,boolValue:string,intValue:string,doubleValue:string,arrayValue:string,"
          "kvlistValue:string,bytesValue:string>")
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
ENVELOPE = (f"resourceLogs array<struct<resource:struct<attributes:{_ATTRS}>,scopeLogs:array<struct<logRecords:array<"
            f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,"
            f"eventName:string,body:{_VALUE},attributes:{_ATTRS}>>>>>>")

# Service name pieces, first match wins.
SERVICES = (("cowork", "cowork"), ("antigravity", "antigravity"), ("claude", "claude-code"), ("codex", "codex"),
            ("gemini", "gemini-cli"), ("qwen", "qwen-code"), ("cursor", "cursor"), ("windsurf", "windsurf"),
            ("vscode", "vscode"), ("vs-code", "vscode"), ("copilot-chat", "vscode"), ("copilot_chat", "vscode"),
            ("copilot", "copilot"), ("opencode", "opencode"), ("openclaw", "openclaw"), ("factory", "factory"),
            ("grok", "grok"), ("devin", "devin-cli"), ("hermes", "hermes"))
# Spellings of a decision.
ALLOW = ("allow", "allowed", "approve", "approved", "accept", "accepted")
DENY = ("deny", "denied", "block", "blocked", "reject", "rejected")
# Event names of the agents' own vocabularies.
_CLAUDE_SHORT = ("user_prompt", "assistant_response", "tool_result", "tool_decision", "permission_mode_changed")
IGNORED = ("gemini_cli.file_operation", "qwen-code.file_operation")
PROMPTS = ("claude_code.user_prompt", "codex.user_prompt", "gemini_cli.user_prompt", "qwen-code.user_prompt",
           "opencode.user_prompt")
REPLIES = ("claude_code.assistant_response", "gemini_cli.api_response", "qwen-code.api_response")
RESULTS = ("claude_code.tool_result", "codex.tool_result", "opencode.tool_result")
CALLS = ("gemini_cli.tool_call", "qwen-code.tool_call")
DECISIONS = ("claude_code.tool_decision", "codex.tool_decision", "opencode.tool_decision")
MODES = ("claude_code.permission_mode_changed", "gemini_cli.plan.approval_mode_switch", "approval_mode_switch")
STARTS = ("codex.conversation_starts", "gemini_cli.config", "qwen-code.config", "gemini_cli.agent.start",
          "opencode.session.created", "gen_ai.session.start", "session.start")
ENDS = ("gemini_cli.conversation_finished", "qwen-code.conversation_finished", "gemini_cli.agent.finish",
        "opencode.session.deleted", "gen_ai.session.end", "session.end")
ELEVATED = ("acceptedits", "auto", "bypasspermissions", "yolo", "auto_edit", "autoedit", "auto-edit")
SHELL_TOOLS = ("bash", "shell", "exec_command", "shell_command", "local_shell", "run_shell_command", "run_terminal_cmd",
               "terminal", "workspacebash", "exec", "execute_bash")
READ_TOOLS = ("read", "read_file", "readfile", "view")
WRITE_TOOLS = ("write", "edit", "multiedit", "notebookedit", "write_file", "replace", "create_file", "edit_file",
               "apply_patch")
WEB_TOOLS = ("webfetch", "web_fetch")
SEARCH_TOOLS = ("websearch", "web_search", "google_web_search")


def _text(v: Column) -> Column:
    return F.coalesce(*[v[n] for n in ("stringValue", "boolValue", "intValue", "doubleValue", "arrayValue",
                                       "kvlistValue", "bytesValue")])


def _as_map(attrs: Column) -> Column:
    pairs = F.transform(F.coalesce(attrs, F.array().cast(_ATTRS)), lambda a: F.struct(a["key"], _text(a["value"])))
    return F.map_from_entries(F.filter(pairs, lambda p: p["key"].isNotNull()))


def log_records(batches: DataFrame, raw: str = "raw") -> DataFrame:
    """Flatten OTLP JSON batches to one row per record with a batch digest."""
    b = batches.select(F.sha2(F.col(raw), 256).alias("batch"), F.from_json(raw, ENVELOPE).alias("j"))
    r = b.select("batch", F.posexplode("j.resourceLogs").alias("ri", "r"))
    s = r.select("batch", "ri", F.col("r.resource.attributes").alias("ra"), F.posexplode("r.scopeLogs").alias("si", "s"))
    x = s.select("batch", "ri", "si", "ra", F.posexplode("s.logRecords").alias("li", "l"))
    return x.select(
        "batch", F.concat_ws("-", "ri", "si", "li").alias("index"), _as_map(F.col("ra")).alias("resource"),
        _as_map(F.col("l.attributes")).alias("attributes"), F.col("l.timeUnixNano").try_cast("bigint").alias("time_unix_nano"),
        F.col("l.observedTimeUnixNano").try_cast("bigint").alias("observed_time_unix_nano"),
        F.col("l.severityNumber").alias("severity_number"), F.col("l.severityText").alias("severity_text"),
        F.col("l.eventName").alias("event_name"), _text(F.col("l.body")).alias("body"))


def service_agent(name: Column) -> Column:
    low = F.lower(trim_space(F.coalesce(name, F.lit(""))))
    out: Column = F.lit("unknown")
    for piece, agent in reversed(SERVICES):
        out = F.when(low.contains(piece), agent).otherwise(out)
    return out


def decision(c: Column) -> Column:
    low = F.lower(trim_space(c))
    return F.when(low.isin(*ALLOW), "allowed").when(low.isin(*DENY), "denied")


# A tool call's own decision words; an edited acceptance is one.
CALL_ALLOW, CALL_DENY = ("accept", "auto_accept", "modify"), ("reject",)


def call_decision(c: Column) -> Column:
    """The decision vocabulary of tool-call records, on the permission values; unknown words give null."""
    low = F.lower(trim_space(c))
    return F.when(low.isin(*CALL_ALLOW), "allowed").when(low.isin(*CALL_DENY), "denied")


def _overlay(base: Column, top: Column) -> Column:
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(top, k)), top)


def map_records(records: DataFrame, event_id: Column | None = None) -> DataFrame:
    """Every record with `status` (mapped, ignored, unmapped) and event columns."""
    none = F.create_map().cast("map<string,string>")
    df = records.withColumn("a", _overlay(F.coalesce("resource", none), F.coalesce("attributes", none)))
    a = F.col("a")
    s = lambda *keys: F.coalesce(*[blank_to_null(F.try_element_at(a, F.lit(k))) for k in keys])
    has = lambda *keys: F.arrays_overlap(F.map_keys(a), F.array(*[F.lit(k) for k in keys]))
    number = lambda k: F.regexp_replace(F.trim(F.try_element_at(a, F.lit(k))), r"\.0+\z", "").try_cast("bigint")
    df = df.withColumns({
        "source_agent": service_agent(s("service.name")),
        "_name": F.lower(F.coalesce(blank_to_null(F.trim("event_name")), F.trim(s("event.name", "event_name")), F.lit(""))),
        "_op": F.lower(F.trim(F.coalesce(s("gen_ai.operation.name"), F.lit(""))))})
    name, op, agent = F.col("_name"), F.col("_op"), F.col("source_agent")
    df = df.withColumn("_name", F.when((agent == "claude-code") & name.isin(*_CLAUDE_SHORT), F.concat(
        F.lit("claude_code."), name)).when((agent == "opencode") & name.isin(
            "user_prompt", "tool_result", "tool_decision", "session.created", "session.deleted"),
            F.concat(F.lit("opencode."), name)).otherwise(name))
    status = F.lower(F.trim(s("status")))
    tool_keys = ("gen_ai.tool.name", "tool.name")
    kind = (F.when(name.isin(*IGNORED), "ignored")
            .when(name.isin(*PROMPTS), "prompt").when(name.isin(*REPLIES), "reply")
            .when(name.isin(*RESULTS), "alias_result").when(name.isin(*CALLS), "alias_call")
            .when(name.isin(*DECISIONS), "alias_decision")
            .when(name.isin(*MODES) & ((name == MODES[0]) | (agent == "gemini-cli")), "mode")
            .when(name.isin(*STARTS), "start").when(name.isin(*ENDS), "end")
            .when((name == "qwen-code.subagent_execution") & (status == "started"), "start")
            .when((name == "qwen-code.subagent_execution") & status.isin("completed", "failed", "cancelled"), "end")
            .when(op == "start_session", "start").when(op == "end_session", "end")
            .when((name == "gen_ai.client.inference.operation.details") | op.isin("chat", "text_completion", "generate_content")
                  | name.startswith("gen_ai.choice") | (name == "gen_ai.assistant.message"), "reply")
            .when((name == "gen_ai.user.message") | has("gen_ai.prompt", "gen_ai.input.messages"), "prompt")
            .when(has("approval.decision", "approval.required", "permission.decision"), "permission")
            .when((op == "execute_tool") | has(*tool_keys) | name.startswith("gen_ai.tool"), "tool")
            .when(has("process.command", "process.command_line", "command"), "command")
            .otherwise("unmapped"))
    df = df.withColumn("_k", kind)
    k = F.col("_k")
    alias = k.isin("alias_result", "alias_call", "alias_decision")
    given = F.coalesce(s("tool_parameters"), F.lit("{}"))
    inputs = F.coalesce(s("tool_input"), s("function_args"), s("arguments"), F.lit("{}"))
    arg = lambda *keys: F.coalesce(*[blank_to_null(F.get_json_object(src, "$." + key))
                                     for src in (given, inputs) for key in keys])
    tool = F.when(alias, s("tool_name", "function_name", *tool_keys)).otherwise(s(*tool_keys))
    df = df.withColumns({
        "tool_name": tool, "_low": F.lower(tool),
        "_url": F.when(k == "tool", s("url.full", "url", "http.url")).when(alias & (k != "alias_decision"), arg("url")),
        "_path": F.when(k == "tool", s("file.path", "code.filepath")).when(
            alias & (k != "alias_decision"), arg("file_path", "notebook_path", "path", "absolute_path")),
        "_cmd": F.when(k == "command", s("command", "process.command_line", "process.command")).when(
            k == "tool", F.coalesce(s("command", "process.command_line", "process.command"), blank_to_null(
                F.coalesce(F.get_json_object(s("gen_ai.tool.call.arguments", "tool.call.arguments"), "$.command"),
                           s("gen_ai.tool.call.arguments", "tool.call.arguments"))))).when(
            alias & (k != "alias_decision"), arg("bash_command", "full_command", "command", "cmd")),
        "_code": number("process.exit.code"), "_ms": number("duration_ms"),
        "_dec": F.when(F.col("event_name").isin(*CALLS), call_decision(s("decision"))).otherwise(
            decision(F.when(k == "alias_decision", s("decision")).otherwise(s("approval.decision", "permission.decision"))))})
    low = F.col("_low")
    verb = lambda *vs: low.rlike(r"(?:\A|[^a-z])(?:" + "|".join(vs) + r")(?:[^a-z]|\z)|\A(?:" + "|".join(vs) + ")")
    file_op = F.lower(F.coalesce(s("file.operation"), F.lit("")))
    file_kind = (F.when(file_op.isin("delete", "remove", "unlink"), "file.delete")
                 .when(file_op.isin("write", "edit", "create", "update", "append"), "file.write")
                 .when(file_op.isin("read", "open", "view"), "file.read")
                 .when(verb("delete", "remove", "unlink"), "file.delete")
                 .when(verb("write", "edit", "create", "update", "append"), "file.write")
                 .when(verb("read", "cat", "view", "open"), "file.read").otherwise("tool.call"))
    measured = F.col("_code").isNotNull() | (F.col("_ms") >= 0)
    shell = low.isin(*SHELL_TOOLS)
    tool_kind = (F.when(F.col("_url").isNotNull(), "network.indicator").when(F.col("_path").isNotNull(), file_kind)
                 .when(shell & measured, "command.result").when(shell, "command.exec").otherwise("tool.call"))
    plain = F.when(k == "alias_result", "tool.result").otherwise("tool.call")
    alias_kind = (F.when(shell, "command.result").when(low.isin(*READ_TOOLS), "file.read")
                  .when(low.isin(*WRITE_TOOLS), "file.write")
                  .when(low.isin(*WEB_TOOLS, *SEARCH_TOOLS), "network.indicator").otherwise(plain))
    asked = F.when(F.col("_dec") == "allowed", "permission.approved").when(
        F.col("_dec") == "denied", "permission.denied").otherwise("permission.requested")
    event = (F.when(k == "prompt", "prompt.user").when(k == "reply", "message.assistant")
             .when(k.isin("alias_result", "alias_call"), alias_kind).when(k.isin("alias_decision", "permission"), asked)
             .when(k == "mode", "config.agent").when(k == "start", "session.start").when(k == "end", "session.end")
             .when(k == "tool", tool_kind).when((k == "command") & measured, "command.result")
             .when(k == "command", "command.exec"))
    df = df.withColumn("event_type", event)
    t = F.col("event_type")
    severity = F.lower(F.trim(F.coalesce("severity_text", F.lit(""))))
    failed = (severity.rlike(r"\A(?:error|fatal)") | F.coalesce(F.col("severity_number").between(17, 24), F.lit(False))
              | F.coalesce(F.lower(s("error", "gen_ai.tool.error")) == "true", F.lit(False)) | s("error.type").isNotNull())
    alias_failed = F.coalesce(F.lower(F.trim(s("success"))) == "false", F.lit(False)) | s("error_type").isNotNull()
    did = k.isin("tool", "alias_result", "alias_call")
    mode = F.when(k == "mode", s("to_mode", "active_approval_mode", "approval_mode")).when(
        k == "start", s("approval_mode", "active_approval_mode"))
    server, part = mcp_parts(F.col("tool_name"))
    mcp = t.isin("tool.call", "tool.result", "network.indicator")
    named = F.coalesce(F.when(alias, F.coalesce(arg("mcp_server_name"), s("mcp_server", "mcp_server_name"))), server)
    is_cmd, is_perm = t.startswith("command."), t.startswith("permission.")
    preview = (F.when(k == "prompt", F.coalesce(s("prompt", "gen_ai.prompt", "gen_ai.input.messages"), F.col("body")))
               .when(k == "reply", F.coalesce(s("response", "response_text", "gen_ai.output.messages"), F.col("body")))
               .when(mode.isNotNull(), mode)
               .when(t == "network.indicator", F.coalesce("_url", arg("query", "prompt"))))
    tag = lambda cond, label: F.when(F.coalesce(cond, F.lit(False)), F.array(F.lit(label)))
    sha = F.lower(F.trim(s("diff.sha256")))
    write = t.isin("file.write", "file.delete")
    ident = event_id if event_id is not None else F.concat(F.lit("otel-"), F.substring("batch", 1, 16), F.lit("-"), F.col("index"))
    out = df.select(
        F.when(k == "ignored", "ignored").when(t.isNull(), "unmapped").otherwise("mapped").alias("status"),
        ident.alias("event_id"), "source_agent", F.lit("otel").alias("source_type"),
        F.coalesce(epoch_to_rfc3339("time_unix_nano", "ns"), epoch_to_rfc3339("observed_time_unix_nano", "ns"),
                   s("event.timestamp")).alias("timestamp"),
        s("gen_ai.conversation.id", "conversation.id", "session.id").alias("session_id"),
        F.when(k == "prompt", "user").when(t.isin("session.start", "session.end", "config.agent"), "system")
        .when(t.isin("command.result", "tool.result"), "tool").otherwise("assistant").alias("actor"), t.alias("event_type"),
        F.when(~t.isin("prompt.user", "message.assistant", "session.start", "session.end", "config.agent"),
               F.col("tool_name")).alias("tool_name"),
        F.when(is_cmd, F.col("_cmd")).alias("command"),
        F.when(t.startswith("file.") | ((t == "tool.call") & (k == "tool")), F.col("_path")).alias("file_path"),
        F.when(is_perm, F.coalesce("_dec", F.lit("asked"))).alias("decision"),
        F.when(did | is_perm, s("gen_ai.tool.call.id", "tool_use_id", "call_id", "tool.call_id")).alias("tool_call_id"),
        F.when(write & sha.rlike(r"\A[0-9a-f]{64}\z"), sha).alias("diff_sha256"),
        F.when(write & (number("diff.bytes") >= 0), number("diff.bytes")).alias("diff_bytes"),
        F.when(t == "command.result", F.col("_code")).cast("int").alias("exit_code"),
        F.when((t == "command.result") & (F.col("_ms") >= 0), F.col("_ms")).alias("duration_ms"),
        F.when(is_perm, F.coalesce(s("approval.required").try_cast("boolean"), F.lit(True))).alias("approval_required"),
        F.when(is_perm, F.coalesce("_dec", F.lit("asked"))).alias("approval_decision"),
        F.when(is_perm, s("approval.reason")).alias("approval_reason"),
        F.when(mcp, named).alias("mcp_server"),
        F.when(mcp & named.isNotNull(), F.coalesce(F.when(alias, arg("mcp_tool_name")), part, F.col("tool_name"))).alias("mcp_tool"),
        F.when(t == "network.indicator", network_target_url("_url")).alias("url"),
        s("gen_ai.response.model", "gen_ai.request.model", "model").alias("model"),
        s("gen_ai.provider.name", "gen_ai.system", "provider_name").alias("model_provider"),
        s("vcs.repository.ref.name").alias("git_branch"), s("app.version", "service.version").alias("cli_version"),
        s("originator").alias("entrypoint"),
        F.coalesce(F.when(alias, arg("subagent_type")), s("subagent_name", "agent_name", "gen_ai.agent.name", "agent_id",
                                                         "gen_ai.agent.id")).alias("sub_agent"),
        content_preview(preview).alias("content_preview"),
        merge_tags(tag(t == "network.indicator", "network"), tag(did & (failed | (alias & alias_failed)), "tool_error"),
                   tag(F.lower(mode).isin(*ELEVATED), "permission_mode_elevated")).alias("tags"),
        F.lit("medium").alias("confidence"), evidence("otel").alias("evidence"))
    return out


def events(records: DataFrame, event_id: Column | None = None) -> DataFrame:
    return conform(keep_rows(map_records(records, event_id), F.col("status") == "mapped"))


def outcome_counts(records: DataFrame) -> DataFrame:
    return map_records(records).groupBy("source_agent", "status").agg(F.count("*").alias("records"))
