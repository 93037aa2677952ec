"""Codex rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from actiontrail.functions.patches import patch_changes
from actiontrail.functions.scalars import blank_to_null, let, network_target_url, trim_space
from actiontrail.operators.pairing import prefer_explicit, tag_nearest
from actiontrail.sources import moments as M

PAYLOAD = ("struct<type:string,id:string,forked_from_id:string,cwd:string,cli_version:string,"
           "model_provider:string,name:string,namespace:string,arguments:string,input:string,call_id:string,"
           "role:string,content:string,action:string,output:string,tools:string,summary:string,turn_id:string,"
           "reason:string,message:string,item:string,result:string>")
ENTRY = f"timestamp string, type string, payload {PAYLOAD}"
_PARTS = "array<struct<type:string,text:string>>"
_UUID7 = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
# Tool names of the rollout format.
SHELL_TOOLS = ("shell", "shell_command", "exec_command")
STATUS_MESSAGES = ("entered_review_mode", "exited_review_mode", "thread_goal_updated", "thread_rolled_back",
                   "turn_aborted")


def _joined_text(c: Column) -> Column:
    parts = F.from_json(c, _PARTS)
    text = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull()), "\n")
    return F.when(c.rlike(r"\A\s*\["), text).otherwise(c)


def _shell_command(args: Column) -> Column:
    """A command given as text or as an argument vector."""
    raw = F.coalesce(F.get_json_object(args, "$.command"), F.get_json_object(args, "$.cmd"))
    argv = F.from_json(raw, "array<string>")
    script = F.when((F.size(argv) == 3) & F.get(argv, F.lit(0)).rlike(r"(?:\A|/)(?:ba|z|da|k)?sh\z")
                    & F.get(argv, F.lit(1)).isin("-c", "-lc"), F.get(argv, F.lit(2)))
    return F.when(raw.rlike(r"\A\s*\["), F.coalesce(script, F.array_join(argv, " "))).otherwise(raw)


def _pointer(p: str) -> Column:
    return F.lit("/payload/" + p)


def _call(p: Column, pointer: Column, tool: Column | None = None, args: Column | None = None, **kw) -> Column:
    return M.moment(kind="call", actor="assistant", tool=tool if tool is not None else p["name"],
                    call_id=blank_to_null(p["call_id"]), args=args, pointer=pointer, **kw)


def _patch_moments(p: Column, text: Column, pointer: Column) -> Column:
    patch = F.when(text.rlike(r"\A\s*\{"), F.coalesce(F.get_json_object(text, "$.input"),
                                                      F.get_json_object(text, "$.patch"), text)).otherwise(text)

    def per_file(body: Column) -> Column:
        changes = patch_changes(body)
        either = F.when(F.size(changes) > 0, changes).otherwise(
            F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit(False).alias("delete"))))
        return F.transform(either, lambda c, i: M.moment(
            kind="call_done", event_type=F.when(c["delete"], "file.delete").otherwise("file.write"),
            actor="assistant", tool=p["name"], call_id=blank_to_null(p["call_id"]), file_path=c["path"],
            diff_sha256=F.when(body != "", F.sha2(body, 256)), diff_bytes=F.when(body != "", F.octet_length(body)),
            tags=F.array(F.lit("patch_requested")), confidence="medium", pointer=pointer, block=i))

    return let(patch, per_file)


def _moments() -> Column:
    p = F.col("e.payload")
    outer, inner = F.col("e.type"), F.col("e.payload.type")
    plain = blank_to_null(p["namespace"]).isNull()
    item, note = outer == "response_item", outer == "event_msg"
    text = trim_space(_joined_text(p["content"]))
    message = F.when((p["role"] == "user") & (text != ""), M.moment(
        kind="prompt_fallback", event_type="prompt.user", actor="user", text=text,
        confidence=F.when(F.col("has_meta"), "medium").otherwise("high"), pointer=_pointer("content"))).when(
        (p["role"] == "assistant") & (text != ""), M.moment(
            kind="event", event_type="message.assistant", actor="assistant", text=text, pointer=_pointer("content")))
    shell = F.to_json(F.struct(_shell_command(p["arguments"]).alias("command")))
    local = F.to_json(F.struct(_shell_command(p["action"]).alias("command")))
    server = blank_to_null(F.regexp_extract(p["namespace"], r"\Amcp__(.+?)(?:__)?\z", 1))
    spaced = F.when(server.isNotNull() & (p["name"] == "fetch") & (server == "fetch"), F.lit("mcp__fetch__fetch"))
    function = (F.when(plain & p["name"].isin(*SHELL_TOOLS), F.array(_call(p, _pointer("arguments"), args=shell)))
                .when(plain & (p["name"] == "apply_patch"), _patch_moments(p, p["arguments"], _pointer("arguments")))
                .otherwise(F.array(_call(p, _pointer("arguments"), tool=F.coalesce(spaced, p["name"]),
                                         args=p["arguments"], mcp_server=server,
                                         mcp_tool=F.when(server.isNotNull(), p["name"])))))
    custom = F.when(plain & (p["name"] == "apply_patch"), _patch_moments(p, p["input"], _pointer("input"))).otherwise(
        F.array(_call(p, _pointer("input"), text=p["input"], mcp_server=server,
                      mcp_tool=F.when(server.isNotNull(), p["name"]))))
    body = F.coalesce(F.get_json_object(p["output"], "$.content"), F.get_json_object(p["output"], "$.output"),
                      _joined_text(p["output"]))
    out = M.moment(kind="result", actor="tool", call_id=blank_to_null(p["call_id"]), text=body,
                   pointer=_pointer("output"))
    action = F.coalesce(*[F.get_json_object(p["action"], k) for k in ("$.query", "$.url", "$.pattern")])
    web = M.moment(kind="event", event_type="network.indicator", actor="assistant", call_id=blank_to_null(p["call_id"]),
                   url=network_target_url(F.get_json_object(p["action"], "$.url")), text=action,
                   tags=F.array(F.lit("network")), pointer=_pointer("action"))
    names = F.array_join(F.transform(F.from_json(p["tools"], "array<struct<name:string>>"), lambda t: t["name"]), ", ")
    thought = trim_space(F.coalesce(blank_to_null(_joined_text(p["summary"])), _joined_text(p["content"])))
    said = trim_space(F.coalesce(blank_to_null(p["message"]),
                                 _joined_text(F.get_json_object(p["item"], "$.content"))))
    is_prompt = (inner == "user_message") | ((inner == "item_completed") & (
        F.lower(F.get_json_object(p["item"], "$.type")).isin("usermessage", "user_message")))
    status = M.moment(kind="event", event_type="message.assistant", actor="system", confidence="low",
                      text=F.when((inner == "turn_aborted") & (p["reason"] != ""),
                                  F.concat(F.lit("turn aborted: "), p["reason"])),
                      tags=F.array(inner), pointer="/payload")
    one = lambda m: F.array_compact(F.array(m))
    return F.coalesce(
        F.when(item & (inner == "message"), one(message))
        .when(item & (inner == "function_call"), function)
        .when(item & (inner == "custom_tool_call"), custom)
        .when(item & (inner == "local_shell_call"), F.array(_call(
            p, _pointer("action"), tool=F.lit("shell"), args=local)))
        .when(item & inner.isin("function_call_output", "custom_tool_call_output"), F.array(out))
        .when(item & (inner == "tool_search_output"), F.array(M.moment(
            kind="event", event_type="tool.result", actor="tool", call_id=blank_to_null(p["call_id"]), text=names,
            pointer=_pointer("tools"))))
        .when(item & (inner == "web_search_call"), F.array(web))
        .when(item & (inner == "tool_search_call"), F.array(_call(
            p, _pointer("arguments"), tool=F.lit("tool_search"), text=F.get_json_object(p["arguments"], "$.query"))))
        .when(item & (inner == "image_generation_call"), F.array(_call(p, F.lit("/payload"), tool=F.lit("image_generation"))))
        .when(item & (inner == "reasoning") & (thought != ""), F.array(M.moment(
            kind="event", event_type="message.reasoning", actor="assistant", text=thought, pointer="/payload")))
        .when(note & is_prompt & (said != ""), F.array(M.moment(
            kind="prompt", event_type="prompt.user", actor="user", text=said,
            pointer=F.when(inner == "user_message", "/payload/message").otherwise("/payload/item/content"))))
        .when(note & inner.isin(*STATUS_MESSAGES), F.array(status)),
        M.no_moments())


def _identity() -> Column:
    return M.path_id("codex", F.col("local_path"), F.col("line"), F.col("block"))


def rollouts(lines: DataFrame, case_id: str | None = None, full: bool = False, agent: str = "codex",
             artifact: str = "codex_rollout") -> tuple[DataFrame, DataFrame]:
    rows, notes = M.parse(lines, ENTRY)
    p, outer = F.col("e.payload"), F.col("e.type")
    notes = notes.unionByName(rows.where(F.coalesce(outer, F.lit("")) == "").select(
        F.col("local_path").alias("path"), "line", F.lit("rollout line missing type").alias("message")))
    meta = outer == "session_meta"
    whole = Window.partitionBy("local_path")
    first = F.min_by(F.when(meta, F.struct(p["id"].alias("id"), p["forked_from_id"].alias("parent"),
                                           F.col("line").alias("line"), p["cli_version"].alias("cli"),
                                           p["model_provider"].alias("provider"), p["cwd"].alias("cwd"))),
                     F.when(meta, F.col("line")))
    rows = rows.withColumn("_m", first.over(whole))
    # A fork starts with a copy of its parent. The child begins at the first
    # task whose time-ordered id is later than the session's own id.
    forked = (F.col("_m.parent") != "") & F.col("_m.id").rlike(_UUID7)
    child = ((outer == "event_msg") & (p["type"] == "task_started") & p["turn_id"].rlike(_UUID7)
             & (F.lower(p["turn_id"]) > F.lower(F.col("_m.id"))))
    rows = rows.withColumn("_forked", F.coalesce(forked, F.lit(False)))
    starts = F.min(F.when(F.col("_forked") & child, F.col("line"))).over(whole)
    rows = rows.withColumn("_start", starts).where(
        ~F.col("_forked") | (F.col("line") <= F.col("_m.line")) | (F.col("line") >= F.col("_start"))).drop("_start")
    along = Window.partitionBy("local_path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    moved = F.when(outer == "turn_context", blank_to_null(p["cwd"]))
    seen = F.max(F.when(meta, F.lit(True)).otherwise(F.lit(False))).over(along)
    rows = rows.withColumns({
        "session_id": F.when(seen, F.col("_m.id")),
        "project_path": F.coalesce(F.last(moved, ignorenulls=True).over(along),
                                   F.first(F.when(meta, blank_to_null(p["cwd"])), ignorenulls=True).over(along)),
        "timestamp": blank_to_null(F.col("e.timestamp")), "has_meta": seen})
    acts = M.explode_moments(rows.withColumn("moments", _moments()).select(
        "local_path", "line", "sha256", "timestamp", "session_id", "project_path", "moments"))
    acts = prefer_explicit(acts, ["local_path"], F.col("kind") == "prompt", F.col("kind") == "prompt_fallback")
    acts = M.promote_results(M.classified(acts, "codex"), consume=True)
    # A failed server call is reported on its own line, before or after the result.
    failures = rows.where((outer == "event_msg") & (p["type"] == "mcp_tool_call_end") & (
        F.coalesce(F.get_json_object(p["result"], "$.Ok.is_error"), F.get_json_object(p["result"], "$.Ok.isError"),
                   F.when(F.get_json_object(p["result"], "$.Err").isNotNull(), F.lit("true"))) == "true")).select(
        "local_path", p["call_id"].alias("call_id"), "line")
    results = acts.where((F.col("event_type") == "tool.result") & F.col("call_id").isNotNull()).select(
        "local_path", "call_id", "line").distinct()
    late = tag_nearest(results, failures, ["local_path", "call_id"], "line").where("failed_late").select(
        "local_path", "call_id", "line", F.lit(True).alias("_late"))
    acts = acts.join(late, ["local_path", "call_id", "line"], "left").withColumn(
        "is_error", F.coalesce("is_error", "_late")).drop("_late")
    events = M.finish(acts, agent, artifact, _identity, case_id, full)
    ends = rows.groupBy("local_path", "sha256").agg(
        F.first("_m", ignorenulls=True).alias("_m"), F.max("line").alias("last_line"),
        F.max_by("timestamp", F.when(F.col("timestamp").isNotNull(), F.col("line"))).alias("last_ts"),
        F.max_by("project_path", "line").alias("last_path"),
        F.min_by("timestamp", F.when(meta, F.col("line"))).alias("first_ts"),
        F.min_by("project_path", F.when(meta, F.col("line"))).alias("first_path")).where(F.col("_m").isNotNull())

    def edge(event: str) -> DataFrame:
        opening = event == "session.start"
        pick = lambda a, b: F.col(a if opening else b)
        base = M.path_id("codex", F.col("local_path"), F.col("_m.line"), F.lit(0))
        f = ends.select(
            "local_path", "sha256", pick("_m.line", "last_line").alias("line"),
            F.coalesce(pick("first_ts", "last_ts"), F.col("first_ts")).alias("timestamp"),
            F.col("_m.id").alias("session_id"), pick("first_path", "last_path").alias("project_path"),
            F.col("_m.cli").alias("cli_version"), F.col("_m.provider").alias("model_provider"),
            M.moment(kind="event", event_type=event, actor="system", block=-1 if opening else 4095,
                     own_id=F.concat(base, F.lit(".start" if opening else ".end")),
                     pointer="/payload" if opening else None).alias("m"))
        return M.finish(f.select("*", "m.*").drop("m"), agent, artifact, _identity, case_id, full)

    return events.unionByName(edge("session.start")).unionByName(edge("session.end")), notes
