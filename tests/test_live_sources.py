"""Telemetry records and hook payloads."""

import json

from actiontrail.operators import contract
from actiontrail.sources import hooks, otlp


def attrs(**kv):
    out = []
    for k, v in kv.items():
        key = k.replace("__", ".")
        kind = "boolValue" if isinstance(v, bool) else "intValue" if isinstance(v, int) else "stringValue"
        out.append({"key": key, "value": {kind: v}})
    return out


def test_otlp(spark):
    rec = lambda name=None, **a: {"timeUnixNano": "1767225600123456789", "eventName": name, "attributes": attrs(**a)}
    batch = {"resourceLogs": [
        {"resource": {"attributes": attrs(service__name="claude-code", session__id="S")}, "scopeLogs": [{"logRecords": [
            rec("claude_code.user_prompt", prompt="hello"),
            rec("tool_result", tool_name="Bash", tool_parameters='{"full_command":"ls"}', duration_ms=5, success="false"),
            rec("claude_code.tool_decision", tool_name="Edit", decision="reject", tool_use_id="t"),
            rec("claude_code.permission_mode_changed", to_mode="bypassPermissions"), rec("nothing.known")]}]},
        {"resource": {"attributes": attrs(service__name="other")}, "scopeLogs": [{"logRecords": [
            rec(gen_ai__operation__name="execute_tool", gen_ai__tool__name="read_file", file__path="/a"),
            rec(gen_ai__tool__name="fetch", url__full="https://x.example/"), rec(command="id", process__exit__code=1),
            rec("gemini_cli.file_operation")]}]}]}
    df = spark.createDataFrame([(json.dumps(batch),)], "raw string")
    recs = otlp.log_records(df)
    mapped = otlp.map_records(recs)
    assert {r.status: r["count"] for r in mapped.groupBy("status").count().collect()} == {
        "mapped": 7, "ignored": 1, "unmapped": 1}
    ev = otlp.events(recs)
    assert contract.quarantine(ev).count() == 0
    rows = ev.orderBy("event_id").collect()
    assert [r.event_type for r in rows] == ["prompt.user", "command.result", "permission.denied", "config.agent",
                                            "file.read", "network.indicator", "command.result"]
    assert rows[0].timestamp == "2026-01-01T00:00:00.123456789Z" and rows[0].session_id == "S"
    assert (rows[1].command, rows[1].duration_ms, rows[1].tags) == ("ls", 5, ["tool_error"])
    assert rows[3].tags == ["permission_mode_elevated"] and rows[6].exit_code == 1
    again = otlp.events(otlp.log_records(df)).select("event_id").collect()
    assert {r.event_id for r in again} == {r.event_id for r in rows}


def test_hooks(spark):
    patch = "*** Begin Patch\n*** Add File: /a\n*** Delete File: /b\n*** End Patch"
    rows = [("claude-code", "PreToolUse", {"session_id": "S", "cwd": "/w", "tool_name": "Bash", "tool_input": {"command": "ls"}}),
            ("claude-code", "PostToolUse", {"tool_name": "Bash", "tool_input": {"command": "ls"}, "tool_response": {"exit_code": 2, "is_error": True}}),
            ("codex", "PreToolUse", {"tool_name": "apply_patch", "tool_input": {"command": patch}}),
            ("copilot", "preToolUse", {"toolName": "read_file", "toolArgs": {"files": ["/x", "/y", "/x"]}, "timestamp": 1767225600000}),
            ("cursor", "beforeSubmitPrompt", {"prompt": "go", "conversation_id": "C", "workspace_roots": ["/w"]}),
            ("cline", "PreToolUse", {"tool_name": "web_fetch", "tool_input": {"url": "https://x.example/"}}),
            ("claude-code", "PermissionDenied", {"tool_name": "Edit", "reason": "no"}), ("claude-code", "Unknown", {})]
    df = spark.createDataFrame([(i, a, e, json.dumps(p)) for i, (a, e, p) in enumerate(rows)],
                               "seq bigint, agent string, event string, payload string")
    ev = hooks.events(df)
    assert contract.quarantine(ev).count() == 0
    got = ev.orderBy("seq").collect()
    assert [(r.event_type, r.command or r.file_path or r.url or r.content_preview) for r in got] == [
        ("command.exec", "ls"), ("command.result", "ls"), ("file.write", "/a"), ("file.delete", "/b"),
        ("file.read", "/x"), ("file.read", "/y"), ("prompt.user", "go"), ("network.indicator", "https://x.example/"),
        ("permission.denied", None)]
    assert got[1].exit_code == 2 and got[1].tags == ["tool_error"] and got[6].project_path == "/w"
    assert got[2].event_id.endswith("-1") and got[4].timestamp == "2026-01-01T00:00:00Z"
