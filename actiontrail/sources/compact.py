"""OpenCode, OpenClaw, Pi and Kimi session stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from actiontrail.functions.scalars import blank_to_null, epoch_to_rfc3339, mcp_parts, trim_space
from actiontrail.sources import codex, moments as M

_BLOCK = ("struct<type:string,text:string,thinking:string,id:string,name:string,arguments:string,input:string>")


def _note(rows: DataFrame, message: str) -> DataFrame:
    return rows.select(F.col("local_path").alias("path"), "line", F.lit(message).alias("message"))


def _blocks(content: Column) -> Column:
    return F.coalesce(F.when(content.rlike(r"\A\s*\["), F.from_json(content, f"array<{_BLOCK}>")),
                      F.when(content != "", F.from_json(F.to_json(F.array(F.struct(
                          F.lit("text").alias("type"), content.alias("text")))), f"array<{_BLOCK}>")),
                      F.array().cast(f"array<{_BLOCK}>"))


# --- one object per file -------------------------------------------------------

PART = ("type string, role string, sessionID string, callID string, tool string, command string, output string, "
        "hash string, files array<string>, text string, modelID string, providerID string, "
        "time struct<created:bigint>, path struct<cwd:string>, "
        "state struct<status:string,input:string,output:string,error:string,time:struct<start:bigint,end:bigint>>")


def opencode(files: DataFrame, case_id: str | None = None, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """`files`: one JSON object per row (local_path, raw, sha256)."""
    rows, notes = M.parse(files.withColumn("line", F.lit(0).cast("bigint")), PART)
    e, kind, role = F.col("e"), F.col("e.type"), F.col("e.role")
    st, call_id = F.col("e.state"), blank_to_null(F.col("e.callID"))
    done = st["status"].isin("completed", "error")
    shell, read = e["tool"] == "bash", e["tool"] == "read"
    server, part = mcp_parts(e["tool"])
    digest = F.when(F.lower(e["hash"]).rlike(r"\A[0-9a-f]{64}\z"), F.lower(e["hash"]))
    tool = F.array_compact(F.array(
        M.moment(kind="call", actor="assistant", tool=e["tool"], call_id=call_id, args=st["input"],
                 event_time=epoch_to_rfc3339(st["time"]["start"], "ms"), pointer="/state/input"),
        F.when(done, M.moment(
            kind="event", event_type=F.when(shell, "command.result").otherwise("tool.result"), actor="tool",
            tool=e["tool"], call_id=call_id, command=F.when(shell, F.get_json_object(st["input"], "$.command")),
            mcp_server=F.when(~shell, server), mcp_tool=F.when(~shell, part), text=F.when(~read, st["output"]),
            is_error=st["status"] == "error", event_time=epoch_to_rfc3339(st["time"]["end"], "ms"),
            pointer="/state", block=1))))
    ran = F.array(
        M.moment(kind="event", event_type="command.exec", actor="assistant", command=e["command"], call_id=call_id,
                 pointer="/command"),
        M.moment(kind="event", event_type="command.result", actor="tool", command=e["command"], call_id=call_id,
                 text=e["output"], pointer="/output", block=1))
    write = lambda path, i, ptr: M.moment(
        kind="event", event_type="file.write", actor="assistant", tool="apply_patch", file_path=path,
        diff_sha256=digest, confidence="medium", block=i, pointer=ptr)
    patch = F.when(F.size("e.files") > 0, F.transform("e.files", lambda f, i: write(
        f, i, F.concat(F.lit("/files/"), i.cast("string"))))).otherwise(F.array(write(None, F.lit(0), F.lit("/hash"))))
    message = F.array(M.moment(
        kind="event", event_type=F.when(role == "user", "prompt.user").otherwise("message.assistant"),
        actor=F.when(role == "user", "user").otherwise("assistant"),
        event_time=epoch_to_rfc3339(F.col("e.time.created"), "ms"), pointer="/role"))
    typed = blank_to_null(kind).isNotNull()
    picked = (F.when(kind == "tool", tool).when(kind == "shell", ran).when(kind == "patch", patch)
              .when(~typed & role.isin("user", "assistant"), message))
    odd = picked.isNull() & ~F.coalesce(kind.isin("text", "reasoning"), F.lit(False))
    notes = notes.unionByName(_note(rows.where(odd), "opencode record is not modeled"))
    none = F.lit(None).cast("string")
    acts = M.explode_moments(rows.select(
        "local_path", "line", "sha256", none.alias("timestamp"), F.col("e.sessionID").alias("session_id"),
        F.when(~typed, F.col("e.path.cwd")).alias("project_path"), F.col("e.modelID").alias("model"),
        F.col("e.providerID").alias("model_provider"), picked.alias("moments")))
    ident = lambda: M.path_id("opencode", F.col("local_path"), F.col("block"))
    return M.finish(M.classified(acts, "opencode"), "opencode", "opencode_storage", ident, case_id, full), notes


# --- message journals ----------------------------------------------------------

ENTRY = ("type string, id string, version int, timestamp string, cwd string, customType string, payload string, "
         "message struct<role:string,content:string,toolCallId:string,toolName:string,command:string,output:string,"
         "exitCode:int,isError:boolean,timestamp:bigint>")


def _message_moments() -> Column:
    msg = F.col("e.message")
    role, blocks = msg["role"], _blocks(msg["content"])
    at = lambda i: F.concat(F.lit("/message/content/"), i.cast("string"))
    say = lambda event, actor, text, i: M.moment(kind="event", event_type=event, actor=actor, text=text, block=i,
                                                 pointer=at(i))
    users = F.transform(blocks, lambda b, i: F.when((b["type"] == "text") & (trim_space(b["text"]) != ""), say(
        "prompt.user", "user", b["text"], i)))
    assistant = F.transform(blocks, lambda b, i: (
        F.when((b["type"] == "text") & (trim_space(b["text"]) != ""), say("message.assistant", "assistant", b["text"], i))
        .when((b["type"] == "thinking") & (trim_space(b["thinking"]) != ""), say(
            "message.reasoning", "assistant", b["thinking"], i))
        .when(F.lower(b["type"]).isin("toolcall", "tool_use"), M.moment(
            kind="call", actor="assistant", tool=b["name"], call_id=blank_to_null(b["id"]),
            args=F.coalesce(b["arguments"], b["input"]), block=i, pointer=at(i)))))
    result = F.array(M.moment(kind="result", actor="tool", tool=msg["toolName"], call_id=blank_to_null(msg["toolCallId"]),
                              is_error=msg["isError"], exit_code=msg["exitCode"], pointer="/message"))
    bash = F.array(
        F.when(msg["command"] != "", M.moment(kind="event", event_type="command.exec", actor="user", tool="bash",
                                              command=msg["command"], pointer="/message/command")),
        F.when(msg["exitCode"].isNotNull() | (msg["output"] != ""), M.moment(
            kind="event", event_type="command.result", actor="tool", tool="bash", exit_code=msg["exitCode"],
            is_error=F.coalesce(msg["exitCode"] != 0, F.lit(False)), pointer="/message", block=1)))
    return F.array_compact(F.coalesce(
        F.when(role == "user", users).when(role == "assistant", assistant)
        .when(F.lower(role).isin("toolresult", "tool"), result).when(role == "bashExecution", bash), M.no_moments()))


def _journal(rows: DataFrame, notes: DataFrame, agent: str, artifact: str, starts: bool, case_id, full):
    e = F.col("e")
    along = Window.partitionBy("local_path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = e["type"] == "session"
    ok = head & (F.coalesce(e["id"], F.lit("")) != "")
    rows = rows.withColumns({
        "session_id": F.last(F.when(ok, e["id"]), ignorenulls=True).over(along),
        "project_path": F.last(F.when(ok, e["cwd"]), ignorenulls=True).over(along),
        "timestamp": F.coalesce(blank_to_null(e["timestamp"]), epoch_to_rfc3339("e.message.timestamp", "ms"))})
    opened = F.array(M.moment(kind="event", event_type="session.start", actor="system"))
    moments = F.when(e["type"] == "message", _message_moments()).when(ok & F.lit(starts), opened)
    quiet = ("session", "message", "model_change", "thinking_level_change", "compaction", "branch_summary", "custom",
             "custom_message", "label", "session_info", "leaf")
    notes = notes.unionByName(_note(rows.where(~F.coalesce(e["type"], F.lit("")).isin(*quiet)), "unhandled entry type"))
    notes = notes.unionByName(_note(rows.where(head & ~ok), "malformed session header"))
    acts = M.explode_moments(rows.select("local_path", "line", "sha256", "timestamp", "session_id", "project_path",
                                         moments.alias("moments")))
    ident = lambda: M.path_id(agent, F.col("local_path"), F.col("line"), F.col("block"))
    acts = M.promote_results(M.classified(acts, agent))
    return M.finish(acts, agent, artifact, ident, case_id, full), notes


def pi(lines: DataFrame, case_id: str | None = None, full: bool = False) -> tuple[DataFrame, DataFrame]:
    rows, notes = M.parse(lines, ENTRY)
    return _journal(rows, notes, "pi", "pi_session", True, case_id, full)


# First recognizable row types of the two flavors.
CODEX_TYPES = ("response_item", "session_meta", "turn_context")
NATIVE_TYPES = ("session", "message", "custom_message", "custom", "compaction", "branch_summary",
                "thinking_level_change", "model_change", "label", "session_info", "leaf")
SNIFF_ROWS = 64


def flavors(lines: DataFrame) -> DataFrame:
    """Per file: codex, native or unknown, from its first decodable rows."""
    rows, _ = M.parse(lines, "type string")
    w = Window.partitionBy("local_path").orderBy("line")
    head = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= SNIFF_ROWS)
    kind = (F.when(F.col("e.type").isin(*CODEX_TYPES), "codex").when(F.col("e.type") == "event_msg", "event_msg")
            .when(F.col("e.type").isin(*NATIVE_TYPES), "native"))
    return head.groupBy("local_path").agg(F.coalesce(
        F.min_by(kind, F.when(kind.isNotNull(), F.col("line"))), F.lit("unknown")).alias("flavor"))


def openclaw(lines: DataFrame, case_id: str | None = None, full: bool = False) -> tuple[DataFrame, DataFrame]:
    # One row per file on the right side; AQE picks the join by its real size.
    tagged = lines.join(flavors(lines), "local_path", "left")
    pick = lambda f: tagged.where(F.col("flavor") == f).drop("flavor")
    rows, notes = M.parse(pick("native"), ENTRY)
    native, notes = _journal(rows, notes, "openclaw", "openclaw_session", False, case_id, full)
    mapped, more = codex.rollouts(pick("codex"), case_id, full, agent="openclaw", artifact="openclaw_session")
    odd = tagged.where(F.coalesce(F.col("flavor"), F.lit("unknown")).isin("unknown", "event_msg")).groupBy(
        "local_path").agg(F.min("line").alias("line"))
    notes = notes.unionByName(more).unionByName(_note(odd, "unrecognized session flavor"))
    return native.unionByName(mapped), notes


WIRE = ("type string, time bigint, protocol_version string, created_at bigint, cwd string, "
        "input array<struct<type:string,text:string>>, origin struct<kind:string>, "
        "event struct<type:string,part:struct<type:string,text:string,think:string>,toolCallId:string,name:string,"
        "args:string,result:struct<isError:boolean>>")


def kimi(lines: DataFrame, case_id: str | None = None, full: bool = False) -> tuple[DataFrame, DataFrame]:
    rows, notes = M.parse(lines, WIRE)
    e, ev = F.col("e"), F.col("e.event")
    notes = notes.unionByName(_note(rows.where(F.coalesce(e["type"], F.lit("")) == ""), "wire record missing type"))
    where = r"(?i)/sessions/[^/]+/([^/]+)/agents/([^/]+)/wire\.jsonl\z"
    slashed = F.translate("local_path", "\\", "/")
    agent_part = F.regexp_extract(slashed, where, 2)
    along = Window.partitionBy("local_path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("local_path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    config = F.when(e["type"] == "config.update", blank_to_null(e["cwd"]))
    rows = rows.withColumns({
        "session_id": blank_to_null(F.regexp_extract(slashed, where, 1)),
        "line_agent": F.when(agent_part != "main", blank_to_null(agent_part)),
        "project_path": F.when(e["type"] == "metadata", F.first(config, ignorenulls=True).over(whole)).otherwise(
            F.last(config, ignorenulls=True).over(along)),
        "timestamp": F.when(e["type"] == "metadata", epoch_to_rfc3339("e.created_at", "ms")).otherwise(
            epoch_to_rfc3339("e.time", "ms"))})
    prompts = F.transform("e.input", lambda p, i: F.when((p["type"] == "text") & (trim_space(p["text"]) != ""), M.moment(
        kind="event", event_type="prompt.user", actor="user", text=p["text"], block=i,
        pointer=F.concat(F.lit("/input/"), i.cast("string")))))
    part = ev["part"]
    loop = (F.when((ev["type"] == "content.part") & (part["type"] == "text") & (trim_space(part["text"]) != ""), M.moment(
                kind="event", event_type="message.assistant", actor="assistant", text=part["text"], pointer="/event/part"))
            .when((ev["type"] == "content.part") & (part["type"] == "think") & (trim_space(part["think"]) != ""), M.moment(
                kind="event", event_type="message.reasoning", actor="assistant", text=part["think"], pointer="/event/part"))
            .when(ev["type"] == "tool.call", M.moment(kind="call", actor="assistant", tool=ev["name"], args=ev["args"],
                                                      call_id=blank_to_null(ev["toolCallId"]), pointer="/event"))
            .when(ev["type"] == "tool.result", M.moment(kind="result", actor="tool", call_id=blank_to_null(ev["toolCallId"]),
                                                        is_error=ev["result"]["isError"], pointer="/event/result")))
    opened = M.moment(kind="event", event_type="session.start", actor="system")
    moments = F.array_compact(F.coalesce(
        F.when((e["type"] == "metadata") & (e["protocol_version"] != ""), F.array(opened))
        .when((e["type"] == "turn.prompt") & (e["origin"]["kind"] == "user"), prompts)
        .when(ev.isNotNull(), F.array(loop)), M.no_moments()))
    acts = M.explode_moments(rows.select("local_path", "line", "sha256", "timestamp", "session_id", "project_path",
                                         "line_agent", moments.alias("moments")))
    acts = M.promote_results(M.classified(acts.withColumn("sub_agent", F.col("line_agent")), "kimi-code"))
    acts = acts.withColumn("tool", F.coalesce("tool", "owner_tool"))
    ident = lambda: M.path_id("kimi", F.col("local_path"), F.col("line"), F.col("block"))
    return M.finish(acts, "kimi-code", "kimi_wire", ident, case_id, full), notes
