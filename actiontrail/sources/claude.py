"""Claude transcripts, the Cowork audit log and prompt histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from actiontrail.functions.scalars import (blank_to_null, content_preview, epoch_to_rfc3339, network_target_url,
                                           trim_space)
from actiontrail.operators.timeline import bookends
from actiontrail.schema import conform, evidence
from actiontrail.sources import moments as M

ENTRY = ("type string, uuid string, sessionId string, agentId string, timestamp string, cwd string, "
         "relocatedCwd string, gitBranch string, version string, permissionMode string, mode string, "
         "prUrl string, agentName string, "
         "attachment struct<type:string,addedNames:array<string>,removedNames:array<string>>, "
         "message struct<role:string,model:string,content:string>, toolUseResult string")
BLOCKS = ("array<struct<type:string,text:string,name:string,id:string,tool_use_id:string,input:string,"
          "is_error:boolean,thinking:string>>")
OUTCOME = ("exit_code int, exitCode int, durationMs bigint, is_error boolean, isError boolean, "
           "interrupted boolean, _bad string")
# Modes that ask for fewer approvals; entry types without activity.
ELEVATED = ("acceptEdits", "auto", "bypassPermissions")
QUIET = ("summary", "system", "ai-title", "custom-title", "queue-operation", "relocated", "last-prompt",
         "file-history-snapshot", "file-history-delta", "worktree-state")
LOUD = ("user", "assistant", "permission-mode", "mode", "pr-link", "agent-name", "attachment")


def _moments() -> Column:
    e, kind = F.col("e"), F.col("e.type")
    pointer = lambda i: F.concat(F.lit("/message/content/"), i.cast("string"))
    said = lambda event, actor, text, i: M.moment(
        kind="event", event_type=event, actor=actor, text=text, block=i, pointer=pointer(i))

    def assistant(b: Column, i: Column) -> Column:
        return (F.when((b["type"] == "text") & (trim_space(b["text"]) != ""),
                       said("message.assistant", "assistant", b["text"], i))
                .when(b["type"] == "tool_use", M.moment(
                    kind="call", actor="assistant", tool=b["name"], call_id=blank_to_null(b["id"]),
                    args=b["input"], block=i, pointer=pointer(i)))
                .when((b["type"] == "thinking") & (trim_space(b["thinking"]) != ""),
                      said("message.reasoning", "assistant", b["thinking"], i)))

    def result(b: Column, i: Column) -> Column:
        return F.when(b["type"] == "tool_result", M.moment(
            kind="result", actor="tool", call_id=blank_to_null(b["tool_use_id"]), block=i,
            exit_code=F.col("exit"), duration_ms=F.col("dur"), is_error=b["is_error"], pointer=pointer(i)))

    results = F.array_compact(F.transform("blocks", result))
    text = F.array_join(F.filter(F.transform("blocks", lambda b: F.when(b["type"] == "text", b["text"])),
                                 lambda t: t.isNotNull()), "\n")
    loose = M.moment(kind="event", event_type=F.when(F.col("exit").isNotNull(), "command.result").otherwise("tool.result"),
                     actor="tool", exit_code=F.col("exit"), duration_ms=F.col("dur"), is_error=F.col("failed"),
                     pointer="/toolUseResult")
    prompt = M.moment(kind="event", event_type="prompt.user", actor="user", text=text, pointer="/message/content")
    user = (F.when(F.size(results) > 0, results).when(F.col("has_outcome"), F.array(loose))
            .when(trim_space(text) != "", F.array(prompt)))
    mode = F.when(kind == "mode", e["mode"]).otherwise(e["permissionMode"])
    mode = trim_space(mode)
    changed = M.moment(
        kind="mode", event_type="config.agent", actor="system", text=mode, event_time=F.col("ts_seen"),
        tags=F.when(mode.isin(*ELEVATED), F.array(F.lit("permission_mode_elevated"))),
        pointer=F.when(kind == "mode", "/mode").otherwise("/permissionMode"))
    link = trim_space(e["prUrl"])
    delta = F.concat_ws("; ", *[F.when(F.size(e["attachment"][f]) > 0, F.concat(
        F.lit(label), F.array_join(e["attachment"][f], ", "))) for f, label in
        (("addedNames", "added: "), ("removedNames", "removed: "))])
    name = trim_space(e["agentName"])
    return F.coalesce(
        F.when(kind == "assistant", F.array_compact(F.transform("blocks", assistant)))
        .when(kind == "user", user)
        .when(kind.isin("mode", "permission-mode") & (mode != ""), F.array(changed))
        .when((kind == "pr-link") & (link != ""), F.array(M.moment(
            kind="event", event_type="network.indicator", actor="system", url=network_target_url(link), text=link,
            tags=F.array(F.lit("network")), pointer="/prUrl")))
        .when((kind == "agent-name") & (name != ""), F.array(M.moment(
            kind="event", event_type="config.agent", actor="system", sub_agent=name, text=name,
            event_time=F.col("ts_seen"), pointer="/agentName")))
        .when((kind == "attachment") & (e["attachment"]["type"] == "deferred_tools_delta") & (delta != ""),
              F.array(M.moment(kind="event", event_type="config.mcp", actor="system", text=delta,
                               confidence="medium", pointer="/attachment"))),
        M.no_moments())


def _identity() -> Column:
    return F.coalesce(F.concat(F.col("uuid"), F.lit("#"), F.col("block").cast("string")),
                      M.path_id("claude", F.col("local_path"), F.col("line"), F.col("block")))


def _sub_agent() -> Column:
    file = F.regexp_extract(F.translate("local_path", "\\", "/"), r"/subagents/agent-([^/]+)\.(?i:jsonl)\z", 1)
    return F.coalesce(blank_to_null(trim_space(F.col("e.agentId"))), blank_to_null(file))


def transcripts(lines: DataFrame, agent: str = "claude-code", artifact_type: str = "claude_jsonl",
                case_id: str | None = None, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """Transcript lines to `(events, diagnostics)`."""
    rows, notes = M.parse(lines, ENTRY)
    e = F.col("e")
    along = Window.partitionBy("local_path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    outcome = F.from_json("e.toolUseResult", OUTCOME, {"columnNameOfCorruptRecord": "_bad"})
    cwd = F.when(e["type"] == "relocated", e["relocatedCwd"]).otherwise(e["cwd"])
    rows = rows.withColumns({
        "project_path": F.last(blank_to_null(cwd), ignorenulls=True).over(along),
        "timestamp": blank_to_null(e["timestamp"]),
        "session_id": blank_to_null(e["sessionId"]), "uuid": blank_to_null(e["uuid"]),
        "git_branch": blank_to_null(e["gitBranch"]), "cli_version": blank_to_null(e["version"]),
        "model": blank_to_null(e["message"]["model"]), "line_agent": _sub_agent(),
        "blocks": F.coalesce(
            F.when(e["message"]["content"].rlike(r"\A\s*\["), F.from_json(e["message"]["content"], BLOCKS)),
            F.when(e["message"]["content"] != "", F.from_json(F.to_json(F.array(F.struct(
                F.lit("text").alias("type"), e["message"]["content"].alias("text")))), BLOCKS)),
            F.array().cast(BLOCKS)),
        "_o": outcome})
    rows = rows.withColumns({
        "ts_seen": F.last("timestamp", ignorenulls=True).over(along),
        "exit": F.coalesce("_o.exit_code", "_o.exitCode"), "dur": F.col("_o.durationMs"),
        "failed": F.coalesce("_o.is_error", "_o.isError", F.lit(False)),
        "has_outcome": F.coalesce(e["toolUseResult"] != "", F.lit(False))}).drop("_o")
    notes = notes.unionByName(rows.where(~F.coalesce(e["type"], F.lit("")).isin(*QUIET, *LOUD)).select(
        F.col("local_path").alias("path"), "line", F.lit("unhandled entry type").alias("message")))
    start, end = bookends(rows.withColumn("ts2", F.col("timestamp")), ["local_path", "sha256"], "line", "session_id",
                          ["git_branch", "cli_version", "model"], "ts2", "line")
    first = rows.where(F.col("session_id").isNotNull()).groupBy("local_path").agg(
        F.min_by(F.struct("uuid", "project_path", "line_agent", "line"), "line").alias("_f"))

    def edge(frame: DataFrame, event: str) -> DataFrame:
        suffix = ".start" if event == "session.start" else ".end"
        f = frame.join(first, "local_path").select(
            "*", F.col("_f.uuid").alias("uuid"), F.col("_f.project_path").alias("project_path"),
            F.col("_f.line_agent").alias("line_agent"), F.col("_f.line").alias("_line0"))
        base = F.coalesce(F.concat(F.col("uuid"), F.lit("#0")), M.path_id(
            "claude", F.col("local_path"), F.col("_line0"), F.lit(0)))
        f = f.withColumn("m", M.moment(kind="event", event_type=event, actor="system",
                                       block=-1 if event == "session.start" else 4095,
                                       own_id=F.concat(base, F.lit(suffix)), sub_agent=F.col("line_agent")))
        return f.select("local_path", "line", "sha256", "timestamp", "session_id", "project_path", "uuid",
                        "git_branch", "cli_version", "model", "m.*")

    rows = rows.withColumn("moments", _moments())
    acts = M.explode_moments(rows.select("local_path", "line", "sha256", "timestamp", "session_id", "project_path",
                                         "uuid", "line_agent", "moments"))
    acts = acts.withColumn("sub_agent", F.coalesce("sub_agent", "line_agent")).drop("line_agent")
    # A repeated mode is not a change; modes are compared per record shape.
    per = Window.partitionBy("local_path", "kind", "pointer").orderBy("line", "block")
    acts = acts.withColumn("_p", F.when(F.col("kind") == "mode", F.lag("text").over(per)))
    acts = acts.where(F.col("_p").isNull() | (F.col("_p") != F.col("text"))).drop("_p")
    acts = M.single_outcome(M.promote_results(M.classified(acts, agent if agent != "cowork" else "claude-code")))
    events = M.finish(acts, agent, artifact_type, _identity, case_id, full)
    edges = M.lifecycle(start, end, lambda f, k: M.finish(edge(f, k), agent, artifact_type, _identity, case_id, full))
    return events.unionByName(edges), notes


def cowork(lines: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    return transcripts(lines, agent="cowork", artifact_type="cowork_jsonl", **kw)


def _history(lines: DataFrame, schema: str, agent: str, artifact: str, prefix: str, text: str,
             clock: Column, project: Column, session: Column, case_id: str | None):
    rows, notes = M.parse(lines, schema)
    notes = notes.withColumn("message", F.lit("malformed history line"))
    rows = rows.where(F.coalesce(F.col(f"e.{text}") != "", F.lit(False)))
    events = rows.select(
        F.lit(case_id).cast("string").alias("case_id"), M.path_id(prefix, F.col("local_path"), F.col("line")).alias("event_id"),
        F.lit(agent).alias("source_agent"), F.lit("artifact").alias("source_type"), clock.alias("timestamp"),
        project.alias("project_path"), session.alias("session_id"), F.lit("user").alias("actor"),
        F.lit("prompt.user").alias("event_type"), content_preview(f"e.{text}").alias("content_preview"),
        F.lit("high").alias("confidence"),
        evidence(artifact, F.col("local_path"), F.col("line"), None, F.col("sha256")).alias("evidence"),
        (F.col("line") * 4096).alias("seq"))
    return conform(events), notes


def claude_history(lines: DataFrame, case_id: str | None = None):
    return _history(lines, "display string, project string, sessionId string, timestamp bigint", "claude-code",
                    "claude_history", "claude-hist", "display", epoch_to_rfc3339("e.timestamp", "ms"),
                    F.col("e.project"), F.col("e.sessionId"), case_id)


def codex_history(lines: DataFrame, case_id: str | None = None):
    return _history(lines, "session_id string, ts bigint, text string", "codex", "codex_history", "codex-hist",
                    "text", epoch_to_rfc3339("e.ts", "s"), F.lit(None).cast("string"), F.col("e.session_id"), case_id)
