"""Cursor, Windsurf and Copilot transcripts: one job, three vocabularies.

These formats spell the same things in several ways, so fields are read with
the first spelling that is present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from actiontrail.functions.scalars import blank_to_null, epoch_to_rfc3339, trim_space
from actiontrail.operators.timeline import bookends
from actiontrail.sources import moments as M

# Record kinds.
USER_KINDS = ("user", "human", "prompt", "userpromptsubmitted", "user_prompt_submitted", "userprompt")
ASSISTANT_KINDS = ("assistant", "ai", "model", "assistantmessage", "assistant_message", "agentmessage",
                   "agent_message")
QUIET_KINDS = ("", "tool", "tool_result", "tool_call", "system", "action", "meta", "metadata", "sessionstart",
               "session_start", "session.start", "sessionend", "session_end", "session.end", "agentstop",
               "agent_stop", "precompact", "pre_compact", "postcompact", "post_compact", "subagentstart",
               "subagent_start", "subagentstop", "subagent_stop")
PRE_KINDS = ("pretooluse", "pre_tool_use", "toolcall", "tool_call", "tooluse", "tool_use", "tool.execution_start")
POST_KINDS = ("posttooluse", "post_tool_use", "toolresult", "tool_result", "posttoolusefailure",
              "tool.execution_complete")
_SPELLINGS = {
    "kind": ("type", "eventType", "hookEventName", "event", "role"),
    "session": ("sessionId", "session_id", "conversationId", "trajectoryId", "cascadeId"),
    "ident": ("id", "bubbleId", "uuid"),
    "cwd": ("cwd", "workspacePath", "projectPath", "workingDirectory", "working_directory"),
    "said": ("text", "prompt", "message"),
    "call": ("toolCallId", "callId", "toolUseId", "call_id", "tool_call_id"),
}
_CALL = ("struct<type:string,name:string,tool:string,toolName:string,callId:string,toolCallId:string,id:string,"
         "input:string,args:string,parameters:string,toolArgs:string,text:string,exitCode:int,exit_code:int,"
         "isError:boolean,is_error:boolean,status:string>")


def _any(e: Column, names) -> Column:
    return F.coalesce(*[blank_to_null(F.try_element_at(e, F.lit(n))) for n in names])


def _clock(e: Column) -> Column:
    raw = _any(e, ("timestamp", "createdAt", "time"))
    n = raw.try_cast("bigint")
    return F.when(n.isNull(), raw).when(n > 100_000_000_000, epoch_to_rfc3339(n, "ms")).otherwise(
        epoch_to_rfc3339(n, "s"))


def _call_moment(c: Column, block: Column, pointer: Column) -> Column:
    name = F.coalesce(blank_to_null(c["name"]), blank_to_null(c["tool"]), blank_to_null(c["toolName"]))
    return F.when(name.isNotNull(), M.moment(
        kind="call", actor="assistant", tool=name,
        call_id=F.coalesce(blank_to_null(c["callId"]), blank_to_null(c["toolCallId"]), blank_to_null(c["id"])),
        args=F.coalesce(c["input"], c["args"], c["parameters"], c["toolArgs"]), block=block, pointer=pointer))


def _result_moment(c: Column, block: Column, pointer: Column) -> Column:
    failed = F.coalesce(c["isError"], c["is_error"], F.lower(c["status"]).isin("error", "failed", "failure"))
    return F.when(c.isNotNull(), M.moment(
        kind="result", actor="tool", call_id=F.coalesce(blank_to_null(c["callId"]), blank_to_null(c["toolCallId"])),
        exit_code=F.coalesce(c["exitCode"], c["exit_code"]), is_error=failed, block=block, pointer=pointer))


def _typed(e: Column, name: str, shape: str) -> Column:
    return F.from_json(F.try_element_at(e, F.lit(name)), shape)


def _moments(agent: str) -> Column:
    e, kind = F.col("m"), F.col("kind_text")
    event = F.when(kind.isin(*USER_KINDS), "prompt.user").when(kind.isin(*ASSISTANT_KINDS), "message.assistant")
    actor = F.when(kind.isin(*USER_KINDS), "user").otherwise("assistant")
    content = F.try_element_at(e, F.lit("content"))
    blocks = F.coalesce(F.when(content.rlike(r"\A\s*\["), F.from_json(content, f"array<{_CALL}>")),
                        F.array().cast(f"array<{_CALL}>"))
    texts = F.array_join(F.filter(F.transform(blocks, lambda b: F.when(
        F.coalesce(b["type"], F.lit("text")).isin("text", "markdown"), b["text"])), lambda t: t.isNotNull()), "\n")
    said = F.coalesce(blank_to_null(trim_space(F.when(content.rlike(r"\A\s*\["), texts).otherwise(content))),
                      blank_to_null(trim_space(_any(e, _SPELLINGS["said"]))))
    where = F.when(content.isNotNull() & (content != ""), "/content").otherwise("/text")
    message = F.when(event.isNotNull() & said.isNotNull(), M.moment(
        kind="event", event_type=event, actor=actor, text=said, block=100, pointer=where))
    if agent == "copilot":
        flat = F.struct(*[_any(e, (n,)).alias(n) for n in ("exitCode", "exit_code", "isError", "error", "status")])
        post, pre = kind.isin(*POST_KINDS), kind.isin(*PRE_KINDS)
        tool = _any(e, ("toolName", "tool_name", "tool"))
        call_id = _any(e, _SPELLINGS["call"])
        failed = (F.lower(flat["isError"]) == "true") | flat["error"].isNotNull() | F.lower(flat["status"]).isin(
            "error", "failed", "failure") | (kind == "posttoolusefailure")
        moment = F.when(post, M.moment(
            kind="result", actor="tool", tool=tool, call_id=call_id, block=200,
            exit_code=F.coalesce(flat["exitCode"], flat["exit_code"]).try_cast("int"), is_error=failed,
            pointer="/toolArgs")).when((pre | tool.isNotNull()) & ~event.isNotNull() & tool.isNotNull(), M.moment(
                kind="call", actor="assistant", tool=tool, call_id=call_id, block=200,
                args=_any(e, ("toolArgs", "tool_input", "toolInput", "args", "input")), pointer="/toolArgs"))
        return F.array_compact(F.array(F.when(~post & ~pre, message), moment))
    path = lambda name, i: F.concat(F.lit(f"/{name}/"), i.cast("string"))
    is_call = lambda b: F.lower(F.coalesce(b["type"], F.lit(""))).isin("tool_use", "tool_call", "toolcall")
    is_res = lambda b: F.lower(F.coalesce(b["type"], F.lit(""))).isin("tool_result", "toolresult")
    inner = F.transform(blocks, lambda b, i: F.when(is_call(b), _call_moment(b, i + 101, path("content", i))).when(
        is_res(b), _result_moment(b, i + 101, path("content", i))))
    many = F.coalesce(F.transform(_typed(e, "toolCalls", f"array<{_CALL}>"), lambda c, i: _call_moment(
        c, i + 1001, path("toolCalls", i))), M.no_moments())
    # Results come before the body, calls after it.
    return F.array_compact(F.concat(
        F.array(_result_moment(_typed(e, "toolResult", _CALL), F.lit(0), F.lit("/toolResult")),
                _result_moment(_typed(e, "output", _CALL), F.lit(1), F.lit("/output")), message),
        inner, F.array(_call_moment(_typed(e, "toolCall", _CALL), F.lit(1000), F.lit("/toolCall"))), many))


def transcripts(lines: DataFrame, agent: str, case_id: str | None = None,
                full: bool = False) -> tuple[DataFrame, DataFrame]:
    artifact = {"cursor": "cursor_transcript", "windsurf": "windsurf_transcript", "copilot": "copilot_events"}[agent]
    typed, notes = M.parse(lines, "type string")
    rows = typed.withColumn("m", F.from_json("raw", "map<string,string>")).drop("e")
    m = F.col("m")
    along = Window.partitionBy("local_path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "kind_text": F.lower(F.coalesce(_any(m, _SPELLINGS["kind"]), F.lit(""))),
        "timestamp": _clock(m), "source_id": _any(m, _SPELLINGS["ident"]),
        "session_id": F.last(_any(m, _SPELLINGS["session"]), ignorenulls=True).over(along),
        "project_path": F.last(_any(m, _SPELLINGS["cwd"]), ignorenulls=True).over(along)})
    known = F.col("kind_text").isin(*USER_KINDS, *ASSISTANT_KINDS, *QUIET_KINDS, *PRE_KINDS, *POST_KINDS)
    notes = notes.unionByName(rows.where(~known).select(
        F.col("local_path").alias("path"), "line", F.lit("unhandled record kind").alias("message")))
    rows = rows.withColumn("moments", _moments(agent))
    ident = lambda: F.coalesce(F.concat(F.col("source_id"), F.lit("#"), F.col("block").cast("string")),
                               M.path_id(agent, F.col("local_path"), F.col("line"), F.col("block")))
    cols = ["local_path", "line", "sha256", "timestamp", "session_id", "project_path", "source_id"]
    acts = M.explode_moments(rows.select(*cols, "moments"))
    # Blocks are renumbered densely so ids do not depend on the slots above.
    acts = acts.withColumn("block", F.row_number().over(
        Window.partitionBy("local_path", "line").orderBy("block")) - 1)
    acts = M.promote_results(M.classified(acts, agent))
    events = M.finish(acts, agent, artifact, ident, case_id, full)
    start, end = bookends(rows.withColumn("ts2", F.col("timestamp")), ["local_path", "sha256"], "line", "session_id",
                          ["project_path"], "ts2", "line")

    def edge(frame: DataFrame, event: str) -> DataFrame:
        opening = event == "session.start"
        own = F.concat(M.path_id(agent, F.col("local_path"), F.col("session_id")),
                       F.lit(".start" if opening else ".end"))
        f = frame.withColumn("mm", M.moment(kind="event", event_type=event, actor="system", own_id=own,
                                            block=-1 if opening else 4095)).withColumn(
            "source_id", F.lit(None).cast("string"))
        return M.finish(f.select(*cols, "mm.*"), agent, artifact, ident, case_id, full)

    return events.unionByName(M.lifecycle(start, end, edge)), notes
