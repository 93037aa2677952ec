"""Gemini session journals, prompt logs and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from actiontrail.functions.scalars import blank_to_null, trim_space
from actiontrail.operators.pairing import latest_open_call
from actiontrail.sources import moments as M

_PART = ("struct<text:string,functionCall:struct<id:string,name:string,args:string>,"
         "functionResponse:struct<id:string,name:string,response:string>>")
_TOOL = ("struct<id:string,name:string,args:string,result:string,resultDisplay:string,status:string,"
         "timestamp:string,agentId:string>")
_MESSAGE = (f"id:string,timestamp:string,type:string,content:string,model:string,toolCalls:array<{_TOOL}>,"
            "thoughts:array<struct<subject:string,description:string,timestamp:string>>")
# Terminal states and the tool whose result is file content.
DONE = ("success", "error", "cancelled")
FILE_CONTENT_TOOLS = ("read_file", "read_many_files")


def _slot(kind: int, i: Column) -> Column:
    """A number of its own for each part of a message: texts, thoughts and calls never meet."""
    return F.lit(kind << 40) + i


def _parts(content: Column) -> Column:
    one = lambda t: F.from_json(F.to_json(F.array(F.struct(t.alias("text")))), f"array<{_PART}>")
    return F.coalesce(
        F.when(content.rlike(r"\A\s*\["), F.from_json(content, f"array<{_PART}>")),
        F.when(content.rlike(r"\A\s*\{"), F.array(F.from_json(content, _PART))),
        F.when(content != "", one(content)), F.array().cast(f"array<{_PART}>"))


def _top_schema() -> str:
    import re

    flat = re.sub(r"(^|,)(id|timestamp|type|content|model|toolCalls|thoughts):", r"\1\2 ", _MESSAGE)
    inner = "sessionId:string,startTime:string,messages:array<struct<" + _MESSAGE + ">>"
    return ("sessionId string, startTime string, messages array<struct<" + _MESSAGE + ">>, "
            "`$set` struct<" + inner + ">, `$rewindTo` string, " + flat)


def _message_versions(rows: DataFrame) -> DataFrame:
    """Every version of every message in journal order."""
    e = F.col("e")
    body = F.struct(*[F.col(f"e.{n}").alias(n) for n in
                      ("id", "timestamp", "type", "content", "model", "toolCalls", "thoughts")])
    none = F.array().cast("array<struct<ptr:string,m:struct<" + _MESSAGE + ">>>")
    listed = lambda arr, root: F.coalesce(F.transform(arr, lambda m, i: F.struct(
        F.concat(F.lit(root), i.cast("string")).alias("ptr"), m.alias("m"))), none)
    own = F.when(blank_to_null(e["id"]).isNotNull(), F.array(F.struct(F.lit("").alias("ptr"), body.alias("m"))))
    every = F.concat(F.coalesce(own, none), listed(F.col("e.messages"), "/messages/"),
                     listed(F.col("e.`$set`.messages"), "/$set/messages/"))
    out = rows.where(F.col("e.`$rewindTo`").isNull()).select(
        "local_path", "sha256", "line", F.posexplode(every).alias("at", "v"))
    return out.select("local_path", "sha256", "line", F.col("v.ptr").alias("ptr"), F.col("v.m").alias("m"),
                      (F.col("line") * 1_000_000 + F.col("at")).alias("version")).where(
        blank_to_null(F.col("m.id")).isNotNull())


def journals(lines: DataFrame, case_id: str | None = None, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """A message's last version wins; a tool call keeps its first version."""
    rows, notes = M.parse(lines, _top_schema())
    notes = notes.withColumn("message", F.lit("malformed session journal record"))
    sid = lambda c: F.coalesce(F.col(f"e.`$set`.{c}"), F.when(
        blank_to_null(F.col("e.id")).isNull(), F.col(f"e.{c}")))
    o = F.col("line")
    meta = rows.groupBy("local_path", "sha256").agg(
        F.max_by(sid("sessionId"), F.when(sid("sessionId").isNotNull(), o)).alias("session_id"),
        F.max_by(sid("startTime"), F.when(sid("startTime").isNotNull(), o)).alias("timestamp"),
        F.min(F.when(sid("sessionId").isNotNull() | sid("startTime").isNotNull(), o)).alias("line"))
    versions = _message_versions(rows).withColumn("message_id", F.col("m.id"))
    latest = versions.groupBy("local_path", "sha256", "message_id").agg(
        F.max_by(F.struct("line", "ptr", "m"), "version").alias("_l"), F.min("version").alias("_order"))
    key = lambda t, i: F.coalesce(blank_to_null(t["id"]), F.concat(t["name"], F.lit(":"), i.cast("string")))
    tools = versions.select("local_path", "message_id", "version", "line", "ptr",
                            F.col("m.timestamp").alias("mts"), F.posexplode("m.toolCalls").alias("ti", "t"))
    tools = tools.withColumn("tkey", key(F.col("t"), F.col("ti")))
    waiting = F.col("t.status") == "awaiting_approval"
    at = F.struct("line", F.concat("ptr", F.lit("/toolCalls/"), F.col("ti").cast("string")).alias("ptr"),
                  F.coalesce(blank_to_null(F.col("t.timestamp")), F.col("mts")).alias("ts"), F.col("t").alias("t"))
    firsts = tools.groupBy("local_path", "message_id", "tkey").agg(
        F.min_by(at, "version").alias("call"), F.min_by(at, F.when(waiting, F.col("version"))).alias("ask"),
        F.max_by(at, "version").alias("last"), F.max("ti").alias("ti"))
    said = latest.select("local_path", "sha256", "message_id", "_order", F.col("_l.line").alias("line"),
                         F.col("_l.ptr").alias("ptr"), F.col("_l.m").alias("m"))
    user = F.col("m.type") == "user"
    texts = F.transform(_parts(F.col("m.content")), lambda p, i: F.when(trim_space(p["text"]) != "", M.moment(
        kind="event", event_type=F.when(user, "prompt.user").otherwise("message.assistant"),
        actor=F.when(user, "user").otherwise("assistant"), text=trim_space(p["text"]), block=_slot(0, i),
        pointer=F.when(F.col("m.content").rlike(r"\A\s*[\[{]"), F.concat(
            F.col("ptr"), F.lit("/content/"), i.cast("string"), F.lit("/text"))).otherwise(
                F.concat(F.col("ptr"), F.lit("/content"))))))
    thoughts = F.coalesce(F.transform("m.thoughts", lambda t, i: F.when(
        trim_space(F.concat_ws(" ", t["subject"], t["description"])) != "", M.moment(
            kind="event", event_type="message.reasoning", actor="assistant", event_time=t["timestamp"],
            text=F.concat_ws(" ", t["subject"], t["description"]), block=_slot(1, i),
            pointer=F.concat(F.col("ptr"), F.lit("/thoughts/"), i.cast("string"))))), M.no_moments())
    known = F.col("m.type").isin("user", "gemini")
    words = M.explode_moments(said.where(known).select(
        "local_path", "sha256", "message_id", "_order", "line", F.col("m.timestamp").alias("timestamp"),
        F.col("m.model").alias("model"), F.array_compact(F.concat(texts, thoughts)).alias("moments")))
    calls = said.where(F.col("m.type") == "gemini").select(
        "local_path", "sha256", "message_id", "_order", F.col("m.model").alias("model"), F.col("m.timestamp").alias("timestamp")).join(
        firsts, ["local_path", "message_id"])
    ask, last, call = F.col("ask"), F.col("last"), F.col("call")
    text = F.coalesce(F.get(F.filter(F.transform(_parts(last["t"]["result"]), lambda p: F.coalesce(
        F.get_json_object(p["functionResponse"]["response"], "$.output"), blank_to_null(p["text"]))),
        lambda x: x.isNotNull()), F.lit(0)), last["t"]["resultDisplay"])
    shell = call["t"]["name"] == "run_shell_command"
    three = F.array_compact(F.array(
        M.moment(kind="call", actor="assistant", tool=call["t"]["name"], call_id=blank_to_null(call["t"]["id"]),
                 args=call["t"]["args"], sub_agent=call["t"]["agentId"], event_time=call["ts"], pointer=call["ptr"],
                 block=_slot(2, F.col("ti") * 3 + 0)),
        F.when(ask.isNotNull(), M.moment(
            kind="event", event_type="permission.requested", actor="system", tool=call["t"]["name"],
            call_id=blank_to_null(call["t"]["id"]), decision="asked", event_time=ask["ts"],
            pointer=F.concat(ask["ptr"], F.lit("/status")), block=_slot(2, F.col("ti") * 3 + 1))),
        F.when(last["t"]["status"].isin(*DONE), M.moment(
            kind="event", event_type=F.when(shell, "command.result").otherwise("tool.result"), actor="tool",
            tool=last["t"]["name"], call_id=blank_to_null(last["t"]["id"]), is_error=last["t"]["status"] == "error",
            command=F.when(shell, F.get_json_object(last["t"]["args"], "$.command")),
            text=F.when(~last["t"]["name"].isin(*FILE_CONTENT_TOOLS), text), event_time=last["ts"],
            pointer=F.concat(last["ptr"], F.lit("/result")), block=_slot(2, F.col("ti") * 3 + 2)))))
    acts = M.explode_moments(calls.where(F.col("call.t.name") != "").select(
        "local_path", "sha256", "message_id", "_order", "model", "timestamp", F.col("last.line").alias("line"),
        three.alias("moments")))
    both = words.unionByName(acts.select(*words.columns))
    both = both.join(meta.select("local_path", "session_id"), "local_path", "left").withColumn(
        "project_path", F.lit(None).cast("string"))
    ident = lambda: M.path_id("gemini", F.col("local_path"), F.col("message_id"), F.col("slot"))
    # One running number for what a line holds: of all its messages in order, and of each message's slots.
    inside = Window.partitionBy("local_path", "line").orderBy("_order", "block")
    both = both.withColumns({"slot": F.col("block"), "block": F.row_number().over(inside).cast("bigint") - 1})
    events = M.finish(M.classified(both, "gemini-cli"), "gemini-cli", "gemini_session", ident, case_id, full, line_step=1 << 21)
    start = meta.where(F.col("line").isNotNull()).withColumns({
        "project_path": F.lit(None).cast("string"), "message_id": F.lit("session"), "slot": F.lit(-1),
        "mm": M.moment(kind="event", event_type="session.start", actor="system", block=-1)})
    opened = M.finish(start.select("*", "mm.*").drop("mm"), "gemini-cli", "gemini_session", ident, case_id, full, line_step=1 << 21)
    return events.unionByName(opened), notes


def prompt_logs(files: DataFrame, case_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """`files`: one row per document (local_path, raw, sha256)."""
    rows = files.withColumn("a", F.from_json("raw", "array<struct<type:string,message:string,sessionId:string,timestamp:string>>"))
    notes = rows.where(F.col("a").isNull()).select(F.col("local_path").alias("path"), F.lit(None).cast("bigint").alias("line"),
                                                  F.lit("malformed logs.json array").alias("message"))
    hit = rows.select("local_path", "sha256", F.posexplode("a").alias("at", "x")).where(
        (F.col("x.type") == "user") & (trim_space(F.col("x.message")) != ""))
    pick = hit.select("local_path", "sha256", F.lit(0).cast("bigint").alias("line"), F.col("x.timestamp").alias("timestamp"),
                      F.col("x.sessionId").alias("session_id"), F.lit(None).cast("string").alias("project_path"),
                      M.moment(kind="event", event_type="prompt.user", actor="user", text=trim_space(F.col("x.message")),
                               block=F.col("at"), pointer=F.concat(F.lit("/"), F.col("at").cast("string"), F.lit("/message"))).alias("mm"))
    ident = lambda: M.path_id("gemini", F.col("local_path"), F.col("block"), F.lit(0))
    return M.finish(pick.select("*", "mm.*").drop("mm"), "gemini-cli", "gemini_logs", ident, case_id), notes


def checkpoints(files: DataFrame, case_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Conversation snapshots; responses pair with the latest open call."""
    shape = f"array<struct<role:string,parts:array<{_PART}>>>"
    history = F.get_json_object("raw", "$.history")
    rows = files.withColumn("root", F.when(F.col("raw").rlike(r"\A\s*\{"), "/history").otherwise("")).withColumn(
        "a", F.from_json(F.when(F.col("root") == "", F.col("raw")).otherwise(history), shape))
    notes = rows.where(F.col("a").isNull()).select(F.col("local_path").alias("path"), F.lit(None).cast("bigint").alias("line"),
                                                  F.lit("malformed checkpoint").alias("message"))
    parts = F.flatten(F.transform("a", lambda m, mi: F.transform(F.coalesce(m["parts"], F.array().cast(f"array<{_PART}>")), lambda p, pi: F.struct(
        mi.alias("mi"), pi.alias("pi"), m["role"].alias("role"), p.alias("p")))))
    p = rows.select("local_path", "sha256", "root", F.posexplode(parts).alias("at", "x")).select("local_path", "sha256", "root", "at", "x.*")
    call, resp = F.col("p.functionCall"), F.col("p.functionResponse")
    p = p.withColumn("name", F.coalesce("p.functionCall.name", "p.functionResponse.name", F.lit("")))
    p = latest_open_call(p, ["local_path"], "name", "at", call.isNotNull(), resp.isNotNull(), F.coalesce(call["id"], resp["id"]),
                         F.struct(call["id"].alias("id"), call["name"].alias("name")), "paired")
    where = lambda kind: F.concat(F.col("root"), F.lit("/"), F.col("mi").cast("string"), F.lit("/parts/"),
                                  F.col("pi").cast("string"), F.lit("/" + kind))
    shell = (resp["name"] == "run_shell_command") | F.coalesce(F.col("paired.name") == "run_shell_command", F.lit(False))
    user = F.col("role") == "user"
    body = F.coalesce(F.get_json_object(resp["response"], "$.output"), F.get_json_object(resp["response"], "$.error"))
    m = (F.when(call.isNotNull(), M.moment(kind="call", actor="assistant", tool=call["name"], call_id=blank_to_null(call["id"]),
                                           args=call["args"], pointer=where("functionCall"), block=F.col("at")))
         .when(resp.isNotNull(), M.moment(
             kind="event", event_type=F.when(shell, "command.result").otherwise("tool.result"), actor="tool",
             tool=resp["name"], call_id=F.coalesce(blank_to_null(resp["id"]), F.col("paired.id")),
             text=F.when(~resp["name"].isin(*FILE_CONTENT_TOOLS), body),
             exit_code=F.get_json_object(resp["response"], "$.exitCode").try_cast("int"),
             is_error=F.get_json_object(resp["response"], "$.error").isNotNull(), pointer=where("functionResponse"), block=F.col("at")))
         .when(trim_space(F.col("p.text")) != "", M.moment(
             kind="event", event_type=F.when(user, "prompt.user").otherwise("message.assistant"),
             actor=F.when(user, "user").otherwise("assistant"), text=trim_space(F.col("p.text")), pointer=where("text"),
             block=F.col("at"))))
    none = F.lit(None).cast("string")
    acts = p.select("local_path", "sha256", F.lit(0).cast("bigint").alias("line"), none.alias("timestamp"),
                    none.alias("session_id"), none.alias("project_path"), m.alias("mm")).where(F.col("mm").isNotNull())
    ident = lambda: M.path_id("gemini", F.col("local_path"), F.col("block"))
    return M.finish(M.classified(acts.select("*", "mm.*").drop("mm"), "gemini-cli"), "gemini-cli", "gemini_chat",
                    ident, case_id), notes
