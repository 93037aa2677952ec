"""Ingest queries: conversation turns and events re-spelled as source records."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from actiontrail.functions.patches import patch_changes
from actiontrail.operators import rules as R
from actiontrail.plans.adapters import ACTIONS_SQL, actions, table
from actiontrail.plans.registry import query
from actiontrail.session import checkpoint_dir
from actiontrail.sources import claude, codex, compact, gemini, hooks, lines as L, otlp, tolerant

_STAMP = "2026-01-01T00:00:00Z"
_CALL = {"command": "ls"}


def _js(**kv: Column | str | int) -> Column:
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*[col(v).alias(k) for k, v in kv.items()])


def _log(spark, sf, path: str, user: Column, other: Column, head: Column | None = None) -> DataFrame:
    """One line per turn: people by `user`, everyone else by `other`."""
    c = table(spark, sf, "conversations")
    cid = F.col("conv_id").cast("string")
    rows = c.select(
        F.concat(F.lit(path), cid, F.lit(".jsonl")).alias("local_path"), (F.col("turn") + 2).alias("line"),
        F.when(F.col("role") == "user", F.to_json(user)).otherwise(F.to_json(other)).alias("raw"))
    if head is not None:
        first = c.where("turn = 0").select(F.concat(F.lit(path), cid, F.lit(".jsonl")).alias("local_path"),
                                           F.lit(1).cast("bigint").alias("line"), F.to_json(head).alias("raw"))
        rows = rows.unionByName(first)
    return rows.withColumn("sha256", F.sha2("local_path", 256))


def _rows(events: DataFrame) -> DataFrame:
    """One row per event; where in its file a session starts or ends is left open."""
    life = F.col("event_type").startswith("session.")
    path = F.regexp_replace("evidence.local_path", "#.*", "")
    return events.select(
        path.alias("path"), F.when(~life, F.col("evidence.line")).alias("line"), "event_type", "session_id",
        F.when(~life, F.substring("timestamp", 1, 19)).alias("timestamp"), "command",
        # Event ids are unique, so a count of equal ids is 1 everywhere.
        F.count(F.lit(1)).over(Window.partitionBy("event_id")).alias("same_id"))


def _expected(prefix: str, *parts: tuple[str, str], line: str = "turn + 2", session: str = "'c' || conv_id",
              stamp: str = f"'{_STAMP[:19]}'", commands: tuple[str, ...] = ("command.exec",)) -> str:
    """`(event type, role filter)` per expected event."""
    return " UNION ALL ".join(
        f"SELECT '{prefix}' || conv_id || '.jsonl' AS path, {'NULL' if kind.startswith('session.') else f'CAST({line} AS BIGINT)'} AS line, "
        f"'{kind}' AS event_type, {session} AS session_id, {'NULL' if kind.startswith('session.') else stamp} AS \"timestamp\", "
        f"{repr('ls') if kind in commands else 'NULL'} AS command, 1 AS same_id FROM conversations WHERE {cond}" for kind, cond in parts)


_USER, _OTHER, _EACH = "role = 'user'", "role <> 'user'", "turn = 0"


# Columns need a running session, so these are made when a query is.
def _sid() -> Column:
    return F.concat(F.lit("c"), F.col("conv_id").cast("string"))


def _cid() -> Column:
    return F.concat(F.lit("k"), F.col("turn").cast("string"))


_TALK = (("prompt.user", _USER), ("message.assistant", _OTHER), ("command.exec", _OTHER))
_LIFE = (("session.start", _EACH), ("session.end", _EACH))


def _claude_lines(spark, sf):
    uid = F.concat(_sid(), F.lit("-"), F.col("turn").cast("string"))
    user = _js(type="user", uuid=uid, sessionId=_sid(), timestamp=_STAMP, message=_js(role="user", content=F.col("text")))
    other = _js(type="assistant", uuid=uid, sessionId=_sid(), timestamp=_STAMP, message=_js(
        role="assistant", content=F.concat(
            F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("id"),
                             F.lit(None).cast("string").alias("name"),
                             F.lit(None).cast("struct<command:string>").alias("input"))),
            F.array(F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), _cid().alias("id"),
                             F.lit("Bash").alias("name"), F.struct(F.lit("ls").alias("command")).alias("input"))))))
    return _log(spark, sf, "/h/.claude/projects/p/", user, other)


@query("S3_claude_transcripts", _expected("/h/.claude/projects/p/", *_TALK, *_LIFE))
def claude_transcripts(spark, sf):
    return _rows(claude.transcripts(_claude_lines(spark, sf))[0])


@query("S3_cowork_audit", _expected("/h/.claude/projects/p/", *_TALK, *_LIFE))
def cowork_audit(spark, sf):
    return _rows(claude.cowork(_claude_lines(spark, sf))[0])


@query("S3_claude_history", _expected("/h/.claude/history-", ("prompt.user", "true"),
        stamp="strftime(make_timestamp(1767225600000000 + turn * 1000), '%Y-%m-%dT%H:%M:%S')"))
def claude_history(spark, sf):
    rec = _js(display=F.col("text"), project="/w", sessionId=_sid(), timestamp=F.col("turn") + 1_767_225_600_000)
    return _rows(claude.claude_history(_log(spark, sf, "/h/.claude/history-", rec, rec))[0])


@query("S3_codex_history", _expected("/h/.codex/history-", ("prompt.user", "true"),
        stamp="strftime(make_timestamp(1767225600000000 + turn * 1000000), '%Y-%m-%dT%H:%M:%S')"))
def codex_history(spark, sf):
    rec = _js(session_id=_sid(), ts=F.col("turn") + 1_767_225_600, text=F.col("text"))
    return _rows(claude.codex_history(_log(spark, sf, "/h/.codex/history-", rec, rec))[0])


def _rollout_lines(spark, sf, path):
    item = lambda **p: _js(timestamp=_STAMP, type="response_item", payload=_js(**p))
    head = _js(timestamp=_STAMP, type="session_meta", payload=_js(id=_sid(), cwd="/w", cli_version="1"))
    user = _js(timestamp=_STAMP, type="event_msg", payload=_js(type="user_message", message=F.col("text")))
    call = item(type="function_call", name="shell", call_id=_cid(), arguments=F.lit('{"command":["bash","-lc","ls"]}'))
    return _log(spark, sf, path, user, call, head)


@query("S3_codex_rollouts", _expected("/h/.codex/sessions/rollout-", ("prompt.user", _USER), ("command.exec", _OTHER), *_LIFE))
def codex_rollouts(spark, sf):
    return _rows(codex.rollouts(_rollout_lines(spark, sf, "/h/.codex/sessions/rollout-"))[0])


@query("S3_openclaw_sessions", _expected("/h/.openclaw/agents/", ("prompt.user", _USER), ("command.exec", _OTHER), *_LIFE))
def openclaw_sessions(spark, sf):
    return _rows(compact.openclaw(_rollout_lines(spark, sf, "/h/.openclaw/agents/"))[0])


def _tolerant_lines(spark, sf, path, tool):
    user = _js(role="user", conversationId=_sid(), timestamp=_STAMP, content=F.col("text"))
    other = _js(role="assistant", conversationId=_sid(), timestamp=_STAMP, text=F.col("text"),
                toolCalls=F.array(_js(name=tool, callId=_cid(), args=_js(**_CALL))))
    return _log(spark, sf, path, user, other)


@query("S3_cursor_transcripts", _expected("/h/.cursor/", *_TALK, *_LIFE))
def cursor_transcripts(spark, sf):
    return _rows(tolerant.transcripts(_tolerant_lines(spark, sf, "/h/.cursor/", "run_terminal_cmd"), "cursor")[0])


@query("S3_windsurf_transcripts", _expected("/h/.windsurf/", *_TALK, *_LIFE))
def windsurf_transcripts(spark, sf):
    return _rows(tolerant.transcripts(_tolerant_lines(spark, sf, "/h/.windsurf/", "run_command"), "windsurf")[0])


@query("S3_copilot_events", _expected("/h/.copilot/", ("prompt.user", _USER), ("command.exec", _OTHER), *_LIFE))
def copilot_events(spark, sf):
    user = _js(type="userPromptSubmitted", sessionId=_sid(), timestamp=_STAMP, prompt=F.col("text"))
    other = _js(type="preToolUse", sessionId=_sid(), timestamp=_STAMP, toolName="Bash", toolCallId=_cid(),
                toolArgs=F.to_json(_js(**_CALL)))
    return _rows(tolerant.transcripts(_log(spark, sf, "/h/.copilot/", user, other), "copilot")[0])


@query("S3_gemini_journals", _expected("/h/.gemini/tmp/a/chats/", *_TALK, ("command.result", _OTHER), ("session.start", _EACH),
                                        commands=("command.exec", "command.result")))
def gemini_journals(spark, sf):
    mid = F.concat(F.lit("m"), F.col("turn").cast("string"))
    user = _js(id=mid, type="user", timestamp=_STAMP, content=F.col("text"))
    other = _js(id=mid, type="gemini", timestamp=_STAMP, content=F.col("text"), toolCalls=F.array(_js(
        id=_cid(), name="run_shell_command", args=_js(**_CALL), status="success")))
    return _rows(gemini.journals(_log(spark, sf, "/h/.gemini/tmp/a/chats/", user, other,
                                        _js(sessionId=_sid(), startTime=_STAMP)))[0])


def _documents(spark, sf, path: str, item: Column) -> DataFrame:
    """One document per conversation: the array of its turns' items."""
    c = table(spark, sf, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.to_json(item).alias("item"))))
    return c.groupBy("conv_id").agg(turns.alias("t")).select(
        F.concat(F.lit(path), F.col("conv_id").cast("string"), F.lit(".json")).alias("local_path"),
        F.concat(F.lit("["), F.array_join(F.transform("t", lambda x: x["item"]), ","), F.lit("]")).alias("raw"),
        F.sha2(F.col("conv_id").cast("string"), 256).alias("sha256"))


_PLACE = "row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1"


@query("S3_gemini_logs", f"""
  SELECT '/h/.gemini/tmp/a/logs-' || conv_id || '.json' AS path, '/' || place || '/message' AS pointer, 'prompt.user' AS event_type,
    'c' || conv_id AS session_id, strftime(make_timestamp(1767225600000000 + turn * 1000000), '%Y-%m-%dT%H:%M:%S') AS "timestamp"
  FROM (SELECT *, {_PLACE} AS place FROM conversations) WHERE role = 'user'""")
def gemini_logs(spark, sf):
    stamp = F.date_format(F.timestamp_seconds(F.col("turn") + 1_767_225_600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    entry = _js(type=F.when(F.col("role") == "user", "user").otherwise("info"), message=F.col("text"), sessionId=_sid(), timestamp=stamp)
    return gemini.prompt_logs(_documents(spark, sf, "/h/.gemini/tmp/a/logs-", entry))[0].select(
        F.col("evidence.local_path").alias("path"), F.col("evidence.json_pointer").alias("pointer"), "event_type", "session_id",
        F.substring("timestamp", 1, 19).alias("timestamp"))


# A turn of the model says something, runs a command and gets its result; ids stand on either side, on both or on neither.
@query("S3_gemini_checkpoints", f"""
  WITH t AS (SELECT *, {_PLACE} AS place, CASE WHEN turn % 3 = 0 THEN 'k' || turn END AS asked, CASE WHEN turn % 2 = 0 THEN 'k' || turn END AS answered FROM conversations),
  p AS (SELECT *, unnest([0, 1, 2]) AS part FROM t)
  SELECT '/h/.gemini/tmp/a/checkpoint-' || conv_id || '.json' AS path,
    '/' || place || '/parts/' || part || ['/text', '/functionCall', '/functionResponse'][part + 1] AS pointer,
    CASE WHEN role = 'user' THEN 'prompt.user' ELSE ['message.assistant', 'command.exec', 'command.result'][part + 1] END AS event_type,
    CASE part WHEN 1 THEN asked WHEN 2 THEN coalesce(answered, asked) END AS tool_call_id,
    CASE WHEN part = 1 THEN 'ls ' || turn END AS command, CASE WHEN part = 2 THEN CAST(turn % 5 AS INT) END AS exit_code
  FROM p WHERE role <> 'user' OR part = 0""")
def gemini_checkpoints(spark, sf):
    turn, k = F.col("turn"), _cid()
    part = lambda **kv: F.struct(*[kv.get(n, F.lit(None).cast(t)).alias(n) for n, t in (
        ("text", "string"), ("functionCall", "struct<id:string,name:string,args:struct<command:string>>"),
        ("functionResponse", "struct<id:string,name:string,response:struct<output:string,exitCode:bigint>>"))])
    shell = F.lit("run_shell_command")
    call = _js(id=F.when(turn % 3 == 0, k), name=shell, args=_js(command=F.concat(F.lit("ls "), turn.cast("string"))))
    answer = _js(id=F.when(turn % 2 == 0, k), name=shell, response=_js(output=F.col("text"), exitCode=(turn % 5).cast("bigint")))
    user = F.col("role") == "user"
    said = part(text=F.col("text"))
    message = _js(role=F.when(user, "user").otherwise("model"), parts=F.when(user, F.array(said)).otherwise(
        F.array(said, part(functionCall=call), part(functionResponse=answer))))
    return gemini.checkpoints(_documents(spark, sf, "/h/.gemini/tmp/a/checkpoint-", message))[0].select(
        F.col("evidence.local_path").alias("path"), F.col("evidence.json_pointer").alias("pointer"), "event_type", "tool_call_id", "command", "exit_code")


@query("S3_opencode_store", _expected("/o/", ("prompt.user", _USER), ("command.exec", _OTHER), ("command.result", _OTHER),
                                       line="0", stamp=f"CASE WHEN role = 'user' THEN '{_STAMP[:19]}' END",
                                       commands=("command.exec", "command.result")))
def opencode_store(spark, sf):
    user = _js(role="user", sessionID=_sid(), time=_js(created=F.lit(1_767_225_600_000)))
    other = _js(type="tool", sessionID=_sid(), callID=_cid(), tool="bash", state=_js(
        status="completed", input=_js(**_CALL), output=F.col("text")))
    rows = _log(spark, sf, "/o/", user, other)
    return _rows(compact.opencode(rows.withColumn("local_path", F.concat_ws("#", "local_path", "line")))[0])


@query("S3_pi_sessions", _expected("/h/.pi/agent/sessions/", *_TALK, ("session.start", _EACH)))
def pi_sessions(spark, sf):
    block = lambda **kv: F.struct(*[F.lit(kv.get(n)).cast(t).alias(n) if not isinstance(kv.get(n), Column) else kv[n].alias(n)
                                    for n, t in (("type", "string"), ("text", "string"), ("id", "string"), ("name", "string"),
                                                 ("arguments", "struct<command:string>"))])
    user = _js(type="message", timestamp=_STAMP, message=_js(role="user", content=F.col("text")))
    other = _js(type="message", timestamp=_STAMP, message=_js(role="assistant", content=F.array(
        block(type="text", text=F.col("text")), block(type="toolCall", id=_cid(), name="bash", arguments=_js(**_CALL)))))
    return _rows(compact.pi(_log(spark, sf, "/h/.pi/agent/sessions/", user, other,
                                   _js(type="session", id=_sid(), version=3, cwd="/w", timestamp=_STAMP)))[0])


@query("S3_kimi_wires", _expected("/h/.kimi/sessions/w/", ("prompt.user", _USER), ("command.exec", _OTHER), ("session.start", _EACH),
                                   session="NULL"))
def kimi_wires(spark, sf):
    user = _js(type="turn.prompt", time=F.lit(1_767_225_600_000), origin=_js(kind="user"),
               input=F.array(_js(type="text", text=F.col("text"))))
    other = _js(type="context.append_loop_event", time=F.lit(1_767_225_600_000), event=_js(
        type="tool.call", toolCallId=_cid(), name="Bash", args=_js(**_CALL)))
    return _rows(compact.kimi(_log(spark, sf, "/h/.kimi/sessions/w/", user, other, _js(
        type="metadata", protocol_version="1", created_at=F.lit(1_767_225_600_000))))[0])


# --- live sources --------------------------------------------------------------

_SERVICE = "CASE user_id % 4 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'codex' WHEN 2 THEN 'gemini-cli' ELSE 'unknown' END"


def _telemetry(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    k = F.regexp_extract("props", "([0-9]+)", 1)
    service = F.element_at(F.array(*[F.lit(x) for x in ("my-claude", "Codex CLI", "gemini", "tool")]),
                           (F.col("user_id") % 4 + 1).cast("int"))
    none = F.create_map().cast("map<string,string>")
    attrs = (F.when(kind == "signup", F.create_map(F.lit("gen_ai.prompt"), F.concat(F.lit("go "), k)))
             .when(kind == "view", F.create_map(F.lit("gen_ai.tool.name"), F.lit("read_file"), F.lit("file.path"), F.concat(F.lit("/f/"), k)))
             .when(kind == "click", F.create_map(F.lit("tool.name"), F.lit("fetch"), F.lit("url.full"), F.concat(F.lit("https://h.example/"), k)))
             .when(kind == "purchase", F.create_map(F.lit("command"), F.lit("ls"), F.lit("process.exit.code"), k))
             .otherwise(none))
    return e.select(
        F.sha2(F.col("event_id").cast("string"), 256).alias("batch"), F.lit("0").alias("index"),
        F.create_map(F.lit("service.name"), service, F.lit("session.id"), F.col("user_id").cast("string")).alias("resource"),
        attrs.alias("attributes"), (F.unix_micros("ts") * 1000).alias("time_unix_nano"),
        F.lit(None).cast("bigint").alias("observed_time_unix_nano"), F.lit(9).alias("severity_number"),
        F.lit("INFO").alias("severity_text"), F.lit(None).cast("string").alias("event_name"), F.lit(None).cast("string").alias("body"))


@query("S5_otlp_events", f"""
  SELECT {_SERVICE} AS source_agent, CASE event_type WHEN 'signup' THEN 'prompt.user' WHEN 'view' THEN 'file.read'
      WHEN 'click' THEN 'network.indicator' ELSE 'command.result' END AS event_type, CAST(user_id AS VARCHAR) AS session_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp", CASE WHEN event_type = 'view' THEN '/f/' || k END AS file_path,
    CASE WHEN event_type = 'click' THEN 'https://h.example/' || k END AS url, CASE WHEN event_type = 'purchase' THEN CAST(k AS INT) END AS exit_code
  FROM (SELECT *, regexp_extract(props, '([0-9]+)', 1) AS k FROM events) AS e WHERE event_type <> 'error'""")
def otlp_events(spark, sf):
    return otlp.events(_telemetry(spark, sf)).select(
        "source_agent", "event_type", "session_id", F.substring("timestamp", 1, 19).alias("timestamp"), "file_path", "url", "exit_code")


@query("F6_P9_telemetry_outcomes", f"""
  SELECT {_SERVICE} AS source_agent, CASE WHEN event_type = 'error' THEN 'unmapped' ELSE 'mapped' END AS status,
    count(*) AS records FROM events GROUP BY ALL""")
def telemetry_outcomes(spark, sf):
    return otlp.outcome_counts(_telemetry(spark, sf))


_MODES = ("acceptEdits", "plan", "bypassPermissions", "default", "YOLO")
_FAILED = ("INFO", "ERROR", "fatal: x", "WARN", "info", "DEBUG")


@query("P24_P25_telemetry_tags", f"""
  WITH e AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE event_type IN ('view', 'signup'))
  SELECT event_type, tag, count(*) AS n FROM (
    SELECT 'file.read' AS event_type, CASE WHEN k % 6 IN (1, 2) OR k % 5 = 3 OR k % 7 IN (1, 2) THEN 'tool_error' ELSE '' END AS tag FROM e WHERE event_type = 'view'
    UNION ALL SELECT 'config.agent', CASE WHEN k % {len(_MODES)} IN (0, 2, 4) THEN 'permission_mode_elevated' ELSE '' END FROM e WHERE event_type = 'signup') AS t
  GROUP BY ALL""")
def telemetry_tags(spark, sf):
    """Failures told by severity number, severity text or attributes; modes that ask for less."""
    e = table(spark, sf, "events").where(F.col("event_type").isin("view", "signup"))
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    view = F.col("event_type") == "view"
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int"))
    read = F.map_concat(F.create_map(F.lit("gen_ai.tool.name"), F.lit("read_file"), F.lit("file.path"), F.lit("/f")),
                        F.when(k % 7 == 1, F.create_map(F.lit("error"), F.lit("True"))).when(
                            k % 7 == 2, F.create_map(F.lit("error.type"), F.lit("timeout"))).otherwise(F.create_map(F.lit("error"), F.lit("false"))))
    rows = e.select(
        F.sha2(F.col("event_id").cast("string"), 256).alias("batch"), F.lit("0").alias("index"),
        F.create_map(F.lit("service.name"), F.lit("my-claude")).alias("resource"),
        F.when(view, read).otherwise(F.create_map(F.lit("to_mode"), pick(_MODES, k))).alias("attributes"),
        (F.unix_micros("ts") * 1000).alias("time_unix_nano"), F.lit(None).cast("bigint").alias("observed_time_unix_nano"),
        F.when(view & (k % 5 == 3), 17).otherwise(9).alias("severity_number"), F.when(view, pick(_FAILED, k)).otherwise("INFO").alias("severity_text"),
        F.when(~view, "claude_code.permission_mode_changed").alias("event_name"), F.lit(None).cast("string").alias("body"))
    return otlp.events(rows).groupBy("event_type", F.coalesce(F.array_join("tags", ","), F.lit("")).alias("tag")).agg(F.count("*").alias("n"))


@query("F5_telemetry_results", """
  SELECT source_type, count(*) AS findings FROM (
    SELECT 'otel' AS source_type FROM events WHERE event_type = 'purchase'
    UNION ALL SELECT 'hook' FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0) AS t GROUP BY source_type""")
def telemetry_results(spark, sf):
    """Telemetry shows some commands only when they are done, so their results count as commands; results from hooks do not."""
    bought = table(spark, sf, "events").where("event_type = 'purchase'")
    done = bought.select(
        F.sha2(F.col("event_id").cast("string"), 256).alias("batch"), F.lit("0").alias("index"),
        F.create_map(F.lit("service.name"), F.lit("my-claude")).alias("resource"),
        F.create_map(F.lit("command"), F.lit("sudo -l"), F.lit("process.exit.code"), F.lit("0")).alias("attributes"),
        (F.unix_micros("ts") * 1000).alias("time_unix_nano"), F.lit(None).cast("bigint").alias("observed_time_unix_nano"),
        F.lit(9).alias("severity_number"), F.lit("INFO").alias("severity_text"), F.lit(None).cast("string").alias("event_name"), F.lit(None).cast("string").alias("body"))
    # From hooks, every second user's command is asked for, the others' are only seen done.
    asked = F.col("user_id") % 2 == 0
    hooked = otlp.events(done).join(bought.select(F.concat(F.lit("otel-"), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 16), F.lit("-0")).alias("event_id"), "user_id"), "event_id")
    hooked = hooked.withColumns({"source_type": F.lit("hook"), "event_type": F.when(asked, "command.exec").otherwise("command.result")}).drop("user_id")
    rules = [r for r in R.load_rules() if r.id == "recon.privilege_escalation"]
    return R.matches(otlp.events(done).unionByName(hooked), rules).groupBy("source_type").agg(F.count("*").alias("findings"))


@query("S6_hook_events", f"""
  SELECT event_type, session_id, "timestamp", command, url, NULL AS file_path FROM ({ACTIONS_SQL})
    WHERE event_type IN ('command.exec', 'network.indicator', 'permission.denied')
  UNION ALL SELECT 'file.read', session_id, "timestamp", NULL, NULL, unnest([file_path, file_path || '.bak']) FROM ({ACTIONS_SQL})
    WHERE event_type = 'file.read'""")
def hook_events(spark, sf):
    a = actions(spark, sf)
    kind = F.col("event_type")
    base = {"session_id": F.col("session_id"), "timestamp": F.col("timestamp"), "cwd": F.col("project_path")}
    payload = (F.when(kind == "command.exec", F.to_json(_js(**base, tool_name="Bash", tool_input=_js(command=F.col("command")))))
               .when(kind == "network.indicator", F.to_json(_js(**base, tool_name="web_fetch", tool_input=_js(url=F.col("url")))))
               .when(kind == "file.read", F.to_json(_js(**base, tool_name="read_file", tool_input=_js(
                   files=F.array(F.col("file_path"), F.concat("file_path", F.lit(".bak")), F.col("file_path"))))))
               .when(kind == "permission.denied", F.to_json(_js(**base, tool_name="Edit", reason="no"))))
    rows = a.where(kind != "config.agent").select(
        "seq", F.lit("copilot").alias("agent"),
        F.when(kind == "permission.denied", "permissionDenied").otherwise("preToolUse").alias("event"), payload.alias("payload"))
    return hooks.events(rows).select("event_type", "session_id", "timestamp", "command", "url", "file_path")


@query("U1_sensor_union", f"""
  SELECT 'otel' AS source_type, count(*) AS events FROM events WHERE event_type <> 'error'
  UNION ALL SELECT 'artifact', (SELECT count(*) FROM conversations)
  UNION ALL SELECT 'hook', (SELECT count(*) FROM events WHERE event_type = 'purchase')""")
def sensor_union(spark, sf):
    rec = _js(display=F.col("text"), project="/w", sessionId=_sid(), timestamp=F.col("turn") + 1_767_225_600_000)
    stored, _ = claude.claude_history(_log(spark, sf, "/h/.claude/history-", rec, rec))
    live = otlp.events(_telemetry(spark, sf))
    asked = actions(spark, sf).where(F.col("event_type") == "command.exec").select(
        "seq", F.lit("copilot").alias("agent"), F.lit("preToolUse").alias("event"),
        F.to_json(_js(session_id=F.col("session_id"), tool_name="Bash", tool_input=_js(command=F.col("command")))).alias("payload"))
    return live.unionByName(hooks.events(asked), allowMissingColumns=True).unionByName(stored, allowMissingColumns=True).groupBy("source_type").agg(F.count("*").alias("events"))


@query("P26b_patch_changes", """
  SELECT doc_id, path, CAST(del AS BOOLEAN) AS "delete" FROM (
    SELECT doc_id, 'src/' || doc_id || '.py' AS path, doc_id % 2 = 0 AS del FROM documents
    UNION ALL SELECT doc_id, 'dst/' || doc_id || '.py', false FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, 'old/' || lang, true FROM documents)""")
def patch_explode(spark, sf):
    d = table(spark, sf, "documents")
    i = F.col("doc_id").cast("string")
    patch = F.concat(F.lit("note\n*** Add File: outside\n*** Begin Patch\n*** Update File: src/"), i, F.lit(".py\n"),
                     F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("*** Move to: dst/"), i, F.lit(".py\n"))).otherwise(F.lit("")),
                     F.lit("@@\n+*** Add File: hunk\n-x\n*** Delete File: old/"), F.col("lang"), F.lit("\n*** End Patch\n"))
    return d.select("doc_id", F.explode(patch_changes(patch)).alias("c")).select("doc_id", "c.path", "c.delete")


_FILED_SQL = """
  WITH filed AS (SELECT conv_id, turn, turn || ' ' || role || ' ' || md5(coalesce(text, '')) AS raw FROM conversations),
  files AS (SELECT conv_id, sha256(string_agg(raw || chr(10), '' ORDER BY turn, raw)) AS sha256, CAST(sum(strlen(raw) + 1) AS BIGINT) AS length FROM filed GROUP BY conv_id)"""


def _filed(spark, sf) -> str:
    """One file per conversation below a new folder of the shared checkpoint folder."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/artifacts-{uuid.uuid4().hex}"
    raw = F.concat_ws(" ", F.col("turn").cast("string"), "role", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    (table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("value")).repartition("conv_id")
     .sortWithinPartitions("conv_id", "turn", "value").select("conv_id", "value").write.partitionBy("conv_id").text(folder))
    return folder


def _conversation(path: str) -> Column:
    return F.regexp_extract(path, "conv_id=([0-9]+)/", 1).cast("bigint")


@query("S1_inventory", _FILED_SQL + " SELECT CAST(conv_id AS BIGINT) AS conv_id, length FROM files")
def inventory(spark, sf):
    """The files of a tree that the conversations were written to, each once."""
    return L.inventory(spark, _filed(spark, sf)).where(F.col("local_path").contains("/part-")).select(_conversation("local_path").alias("conv_id"), "length")


@query("S2_hashed_lines", _FILED_SQL + """
  SELECT CAST(conv_id AS BIGINT) AS conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, raw) AS line, raw, sha256
  FROM filed JOIN files USING (conv_id)""")
def hashed_lines(spark, sf):
    """Numbered lines with their file's digest, from one pass over each file."""
    rows, _ = L.hashed_lines(spark, _filed(spark, sf))
    return rows.select(_conversation("local_path").alias("conv_id"), "line", "raw", "sha256")
