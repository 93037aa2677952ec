"""Session-log jobs on own fixtures: one small artifact per format."""

import json

from pyspark.sql import functions as F

from actiontrail.operators import contract
from actiontrail.sources import claude, codex, compact, gemini, tolerant

SHA = "a" * 64


def lines(spark, path, objs):
    rows = [(path, i + 1, o if isinstance(o, str) else json.dumps(o), SHA) for i, o in enumerate(objs)]
    return spark.createDataFrame(rows, "local_path string, line bigint, raw string, sha256 string")


def run(result):
    events, notes = result
    assert contract.quarantine(events).count() == 0
    rows = events.orderBy("seq", "event_id").collect()
    assert len({r.event_id for r in rows}) == len(rows)
    return rows, [r.message for r in notes.orderBy("line", "message").collect()]


def kinds(rows):
    return [r.event_type for r in rows]


def one(rows, kind):
    found = [r for r in rows if r.event_type == kind]
    assert len(found) == 1, kind
    return found[0]


CLAUDE = [
    {"type": "mode", "mode": "auto", "sessionId": "S1"},
    {"type": "user", "uuid": "u1", "sessionId": "S1", "timestamp": "2026-01-01T00:00:00Z", "cwd": "/w",
     "gitBranch": "main", "version": "1.2", "message": {"role": "user", "content": "fix  it\nnow"}},
    {"type": "assistant", "uuid": "a1", "sessionId": "S1", "timestamp": "2026-01-01T00:00:01Z",
     "message": {"role": "assistant", "model": "m", "content": [
         {"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls -la"}},
         {"type": "tool_use", "id": "t2", "name": "mcp__gh__pr", "input": {}}, {"type": "thinking", "thinking": "hmm"},
         {"type": "tool_use", "id": "t3", "name": "WebFetch", "input": {"url": "https://x.example/a"}}]}},
    {"type": "user", "uuid": "u2", "sessionId": "S1", "timestamp": "2026-01-01T00:00:02Z", "message": {
        "role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "is_error": True},
                                    {"type": "tool_result", "tool_use_id": "t2"}]},
     "toolUseResult": {"exit_code": 2, "durationMs": 5}},
    {"type": "mode", "mode": "auto", "sessionId": "S1"}, {"type": "mode", "mode": "default", "sessionId": "S1"},
    "not json", {"type": "weird"},
]


def test_claude(spark):
    rows, notes = run(claude.transcripts(lines(spark, "/h/.claude/projects/p/s.jsonl", CLAUDE)))
    assert kinds(rows) == ["session.start", "config.agent", "prompt.user", "message.assistant", "command.exec",
                           "tool.call", "network.indicator", "command.result", "tool.result", "config.agent",
                           "session.end"]
    result = one(rows, "command.result")
    assert (result.exit_code, result.duration_ms, result.tags) == (2, 5, ["tool_error"])
    assert one(rows, "tool.call").mcp_server == "gh"
    assert one(rows, "command.exec").event_id == "a1#1"
    start, end = one(rows, "session.start"), one(rows, "session.end")
    assert (start.git_branch, start.cli_version, end.timestamp) == ("main", "1.2", "2026-01-01T00:00:02Z")
    assert start.event_id.removesuffix(".start") == end.event_id.removesuffix(".end")
    assert notes == ["malformed JSON line", "unhandled entry type"]


def test_claude_full_profile_adds_reasoning(spark):
    rows, _ = run(claude.transcripts(lines(spark, "/h/s.jsonl", CLAUDE), full=True))
    assert one(rows, "message.reasoning").content_preview == "hmm"
    assert one(rows, "session.start").model == "m"


def test_histories(spark):
    rows, notes = run(claude.claude_history(lines(spark, "/h/history.jsonl", [
        {"display": "hello", "project": "/p", "sessionId": "s", "timestamp": 1767225600123}, {"display": ""}, "x{"])))
    assert [(r.timestamp, r.content_preview) for r in rows] == [("2026-01-01T00:00:00.123Z", "hello")]
    assert notes == ["malformed history line"]
    rows, _ = run(claude.codex_history(lines(spark, "/h/c.jsonl", [{"session_id": "s", "ts": 1767225600, "text": "hi"}])))
    assert rows[0].timestamp == "2026-01-01T00:00:00Z"


def rollout(extra=(), meta=None):
    return [
        {"timestamp": "2026-01-01T00:00:00Z", "type": "session_meta", "payload": {
            "id": "s-1", "cwd": "/w", "cli_version": "0.1", "model_provider": "p", **(meta or {})}},
        {"timestamp": "2026-01-01T00:00:01Z", "type": "response_item", "payload": {
            "type": "message", "role": "user", "content": [{"type": "input_text", "text": "hello"}]}}, *extra]


def item(**p):
    return {"timestamp": "2026-01-01T00:00:05Z", "type": "response_item", "payload": p}


def note(**p):
    return {"timestamp": "2026-01-01T00:00:06Z", "type": "event_msg", "payload": p}


def test_codex(spark):
    patch = ("*** Begin Patch\n*** Update File: a.py\n*** Move to: b.py\n@@\n+*** Add File: no\n"
             "*** Delete File: c.py\n*** End Patch")
    rows, _ = run(codex.rollouts(lines(spark, "/h/rollout-1.jsonl", rollout([
        note(type="user_message", message="hello"), {"type": "turn_context", "payload": {"cwd": "/w2"}},
        item(type="function_call", name="shell", arguments=json.dumps({"command": ["bash", "-lc", "ls | wc"]}), call_id="c1"),
        item(type="function_call_output", call_id="c1", output="3"),
        item(type="function_call_output", call_id="c1", output="again"),
        item(type="custom_tool_call", name="apply_patch", call_id="c2", input=patch),
        item(type="function_call", name="mcp__db__q", arguments="{}", call_id="c3"),
        item(type="function_call_output", call_id="c3", output="err"),
        note(type="mcp_tool_call_end", call_id="c3", result={"Err": "boom"}),
        note(type="turn_aborted", reason="interrupted")]))))
    assert kinds(rows) == ["session.start", "prompt.user", "command.exec", "command.result", "tool.result",
                           "file.delete", "file.write", "file.delete", "tool.call", "tool.result",
                           "message.assistant", "session.end"]
    assert one(rows, "command.exec").command == "ls | wc" and one(rows, "command.exec").project_path == "/w2"
    assert [r.file_path for r in rows if r.file_path] == ["a.py", "b.py", "c.py"]
    assert rows[9].tags == ["tool_error"] and rows[1].evidence.json_pointer == "/payload/message"


def test_codex_fallback_prompt_and_fork(spark):
    rows, _ = run(codex.rollouts(lines(spark, "/h/rollout-2.jsonl", rollout())))
    assert (one(rows, "prompt.user").confidence, one(rows, "prompt.user").content_preview) == ("medium", "hello")
    own, old, new = (f"0190000{n}-0000-7000-8000-000000000000" for n in (5, 1, 9))
    fork = rollout([note(type="task_started", turn_id=old), note(type="user_message", message="copied"),
                    note(type="task_started", turn_id=new), note(type="user_message", message="child")],
                   {"id": own, "forked_from_id": "parent"})
    rows, _ = run(codex.rollouts(lines(spark, "/h/rollout-3.jsonl", fork)))
    assert [r.content_preview for r in rows if r.event_type == "prompt.user"] == ["child"]


def test_cursor_and_windsurf(spark):
    log = [{"role": "user", "conversationId": "C1", "timestamp": 1767225600000, "content": "do it", "cwd": "/w"},
           {"role": "assistant", "content": [{"type": "text", "text": "sure"}, {
               "type": "tool_use", "id": "k1", "name": "Shell", "input": {"command": "rm x"}}]},
           {"role": "tool", "toolResult": {"callId": "k1", "exitCode": 1, "isError": True}},
           {"role": "assistant", "text": "done", "toolCalls": [{"name": "read_file", "callId": "k2", "args": {"path": "/a"}}]},
           {"type": "banana"}]
    for agent in ("cursor", "windsurf"):
        rows, notes = run(tolerant.transcripts(lines(spark, f"/h/.{agent}/x.jsonl", log), agent))
        assert kinds(rows) == ["session.start", "prompt.user", "message.assistant", "command.exec", "command.result",
                               "message.assistant", "file.read", "session.end"]
        assert one(rows, "command.result").exit_code == 1 and one(rows, "file.read").file_path == "/a"
        assert notes == ["unhandled record kind"]


def test_copilot(spark):
    rows, _ = run(tolerant.transcripts(lines(spark, "/h/.copilot/x.jsonl", [
        {"type": "userPromptSubmitted", "sessionId": "P1", "timestamp": "2026-01-01T00:00:00Z", "prompt": "hi"},
        {"type": "preToolUse", "toolName": "Bash", "toolCallId": "q", "toolArgs": "{\"command\":\"ls\"}"},
        {"type": "postToolUse", "toolName": "Bash", "toolCallId": "q", "exitCode": 0}]), "copilot"))
    assert kinds(rows) == ["session.start", "prompt.user", "command.exec", "command.result", "session.end"]
    assert one(rows, "command.result").exit_code == 0


def test_gemini_journal(spark):
    call = {"id": "t1", "name": "run_shell_command", "args": {"command": "ls"}, "status": "awaiting_approval",
            "timestamp": "2026-01-01T00:00:03Z"}
    log = [{"sessionId": "G1", "startTime": "2026-01-01T00:00:00Z"},
           {"id": "m1", "type": "user", "timestamp": "2026-01-01T00:00:01Z", "content": "hello"},
           {"id": "m2", "type": "gemini", "timestamp": "2026-01-01T00:00:02Z", "content": "first", "toolCalls": [call]},
           {"$rewindTo": "m1"},
           {"id": "m2", "type": "gemini", "timestamp": "2026-01-01T00:00:02Z", "content": "last", "toolCalls": [
               {**call, "status": "error", "args": {"command": "changed"}, "resultDisplay": "boom"}]}]
    rows, _ = run(gemini.journals(lines(spark, "/h/.gemini/tmp/a/chats/s.jsonl", log)))
    assert sorted(kinds(rows)) == ["command.exec", "command.result", "message.assistant", "permission.requested",
                                   "prompt.user", "session.start"]
    assert one(rows, "message.assistant").content_preview == "last"
    assert one(rows, "command.exec").command == "ls"
    assert one(rows, "command.result").tags == ["tool_error"]
    assert {r.session_id for r in rows} == {"G1"}


def test_gemini_documents(spark):
    doc = lambda obj: spark.createDataFrame([("/h/f.json", json.dumps(obj), SHA)],
                                            "local_path string, raw string, sha256 string")
    rows, _ = run(gemini.prompt_logs(doc([{"type": "user", "message": "hi"}, {"type": "x", "message": "no"}])))
    assert [r.content_preview for r in rows] == ["hi"]
    f = lambda name: {"functionCall": {"name": name, "args": {"command": "ls"}}}
    chat = [{"role": "user", "parts": [{"text": "go"}]},
            {"role": "model", "parts": [f("run_shell_command"), f("other")]},
            {"role": "user", "parts": [{"functionResponse": {"name": "other", "response": {"output": "o"}}},
                                       {"functionResponse": {"name": "run_shell_command", "response": {
                                           "output": "x", "exitCode": 3}}}]}]
    rows, _ = run(gemini.checkpoints(doc(chat)))
    assert kinds(rows) == ["prompt.user", "command.exec", "tool.call", "tool.result", "command.result"]
    assert one(rows, "command.result").exit_code == 3


def test_opencode(spark):
    docs = [("/o/1", {"type": "tool", "sessionID": "O1", "callID": "c", "tool": "bash", "state": {
                "status": "completed", "input": {"command": "ls"}, "output": "x", "time": {"start": 1767225600000, "end": 1767225601000}}}),
            ("/o/2", {"role": "user", "sessionID": "O1", "time": {"created": 1767225600000}, "path": {"cwd": "/w"}}),
            ("/o/3", {"type": "patch", "sessionID": "O1", "hash": "ab", "files": ["/a", "/b"]}), ("/o/4", {"type": "odd"})]
    df = spark.createDataFrame([(p, json.dumps(o), SHA) for p, o in docs], "local_path string, raw string, sha256 string")
    rows, notes = run(compact.opencode(df))
    assert sorted(kinds(rows)) == ["command.exec", "command.result", "file.write", "file.write", "prompt.user"]
    assert notes == ["opencode record is not modeled"]


JOURNAL = [{"type": "session", "id": "J1", "version": 3, "cwd": "/w", "timestamp": "2026-01-01T00:00:00Z"},
           {"type": "message", "timestamp": "2026-01-01T00:00:01Z", "message": {"role": "user", "content": "hi"}},
           {"type": "message", "timestamp": "2026-01-01T00:00:02Z", "message": {"role": "assistant", "content": [
               {"type": "text", "text": "ok"}, {"type": "toolCall", "id": "x", "name": "bash", "arguments": {"command": "ls"}}]}},
           {"type": "message", "timestamp": "2026-01-01T00:00:03Z", "message": {
               "role": "toolResult", "toolCallId": "x", "toolName": "bash", "isError": True}}]


def test_pi(spark):
    rows, _ = run(compact.pi(lines(spark, "/h/.pi/agent/sessions/a.jsonl", JOURNAL + [
        {"type": "message", "message": {"role": "bashExecution", "command": "id", "exitCode": 1, "timestamp": 1767225600000}}])))
    assert kinds(rows) == ["session.start", "prompt.user", "message.assistant", "command.exec", "command.result",
                           "command.exec", "command.result"]
    assert rows[-1].exit_code == 1 and rows[-1].tags == ["tool_error"]


def test_openclaw_flavors(spark):
    native = lines(spark, "/h/.openclaw/n.jsonl", [json.loads(json.dumps(o).replace('"bash"', '"exec"')) for o in JOURNAL])
    both = native.unionByName(lines(spark, "/h/.openclaw/c.jsonl", rollout())).unionByName(
        lines(spark, "/h/.openclaw/u.jsonl", [{"type": "hm"}]))
    rows, notes = run(compact.openclaw(both))
    by = {}
    for r in rows:
        by.setdefault(r.evidence.local_path[-7], []).append(r.event_type)
    assert by["n"] == ["prompt.user", "message.assistant", "command.exec", "command.result"]
    assert by["c"] == ["session.start", "prompt.user", "session.end"]
    assert {r.source_agent for r in rows} == {"openclaw"} and "unrecognized session flavor" in notes


def test_kimi(spark):
    event = lambda **e: {"type": "context.append_loop_event", "time": 1767225601000, "event": e}
    rows, _ = run(compact.kimi(lines(spark, "/h/.kimi-code/sessions/w/K1/agents/sub/wire.jsonl", [
        {"type": "metadata", "protocol_version": "1", "created_at": 1767225600000},
        {"type": "config.update", "cwd": "/w"},
        {"type": "turn.prompt", "time": 1767225600500, "origin": {"kind": "user"}, "input": [{"type": "text", "text": "go"}]},
        event(type="tool.call", toolCallId="k", name="Bash", args={"command": "ls"}),
        event(type="tool.result", toolCallId="k", result={"isError": True})])))
    assert kinds(rows) == ["session.start", "prompt.user", "command.exec", "command.result"]
    assert rows[0].project_path == "/w" and rows[0].sub_agent == "sub" and rows[0].session_id == "K1"
    assert rows[3].tool_name == "Bash"


def test_files_on_disk(spark, tmp_path):
    from actiontrail.sources.lines import agent_roots, inventory, numbered_lines

    home = tmp_path / ".claude" / "projects" / "p"
    home.mkdir(parents=True)
    (home / "s.jsonl").write_text("\n".join(json.dumps(o) if not isinstance(o, str) else o for o in CLAUDE))
    (tmp_path / ".claude" / "notes.txt").write_text("x")
    root = agent_roots(str(tmp_path))[0]
    found = {r.local_path.rsplit("/", 1)[1]: r.source_agent for r in inventory(spark, root).collect()}
    assert found == {"s.jsonl": "claude-code", "notes.txt": None}
    rows, _ = numbered_lines(spark, str(home))
    assert [r.line for r in rows.orderBy("line").collect()] == list(range(1, len(CLAUDE) + 1))
    events, _ = claude.transcripts(rows)
    assert events.count() == 11 and events.where(F.length("evidence.sha256") != 64).count() == 0
