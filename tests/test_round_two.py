"""Command texts that are partly unread, exact call pairing, JSON redaction, manifests, selection and filters."""

import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from actiontrail.functions.commands import command_columns
from actiontrail.functions.redact import redact_json, redact_text
from actiontrail.operators import cases, contract, indicators, pairing, verdicts
from actiontrail.sources import lines, otlp, records
from actiontrail.streaming import jobs

RM = ("rm", ["-rf", "/"])
# (text, statements that have to be there, notes)
TEXTS = (
    ("for i in 1; do rm -rf /; done", [RM], ["control flow"]),
    ("if true; then sudo -i; fi", [("true", []), ("sudo", ["-i"])], ["control flow"]),
    ("cat <<EOF\nrm x\nEOF\nrm -rf /", [("cat", []), RM], ["here-document"]),
    ("true;" * 200 + "rm -rf /", [RM], []),
    ("sh -c \"sh -c 'sh -c \\\"rm -rf /\\\"'\"", [RM], []),
    ("echo '<<E'\nrm -rf /\nE", [("echo", ["<<E"]), RM], []),
    ("case x in a) rm -rf /;; esac", [RM], ["control flow"]),
    ("rm -rf /; echo 'x", [RM], ["unclosed quote"]),
    ("echo 'x; rm -rf /", [], ["unclosed quote", "no command"]),
    ("f() { rm -rf /; }; f", [RM, ("f", [])], ["control flow"]),
    ("(cd /x && rm -rf /)", [("cd", ["/x"]), RM], ["control flow"]),
    ("git commit -m 'if x; then y'", [("git", ["commit", "-m", "if x; then y"])], []),
    ("echo $(echo $(echo $(echo $(id))))", [("echo", ["$(id)"])], ["nested too deep"]),
)


def test_partly_unread_commands(spark):
    rows = command_columns(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(TEXTS)], "i int, command string")).collect()
    for r in rows:
        _, want, notes = TEXTS[r.i]
        found = [(c.name, list(c.operands)) for c in r.commands]
        assert all(w in found for w in want) and r.command_notes == notes, (r.command, found, r.command_notes)
        assert not (notes and r.command_static) and len({c.statement_id for c in r.commands}) == len(r.commands)
        if not want:
            assert not found


def test_calls_pair_by_name_and_ids_where_both_have_one(spark):
    rows = [("f", 1, "call", "n", None), ("f", 2, "call", "n", "a"), ("f", 3, "resp", "n", "b"), ("f", 4, "resp", "n", None),
            ("f", 5, "resp", "n", None), ("f", 6, "call", "n", "c"), ("f", 7, "resp", "n", "c"), ("f", 8, "call", "n", "d"), ("f", 9, "resp", "m", "d")]
    df = spark.createDataFrame(rows, "g string, at long, kind string, name string, id string")
    out = pairing.latest_open_call(df, ["g"], "name", "at", F.col("kind") == "call", F.col("kind") == "resp", F.col("id"), F.col("at"))
    got = {r["at"]: r["matched"] for r in out.collect()}
    assert got == {1: None, 2: None, 3: 1, 4: 2, 5: None, 6: None, 7: 6, 8: None, 9: None}


def open_calls(rows):
    stack, out = {}, {}
    for g, at, kind, name, ident in sorted(rows, key=lambda r: r[1]):
        calls = stack.setdefault((g, name), [])
        if kind == "call":
            calls.append((at, ident))
        elif kind == "resp":
            hit = next((c for c in reversed(calls) if not c[1] or not ident or c[1] == ident), None)
            if hit:
                calls.remove(hit)
                out[g, at] = hit[0]
    return out


@pytest.mark.parametrize(("seed", "slice_rows", "fan"), [(1, 3, 2), (2, 10, 2), (3, 1, 4), (4, 1000, 2)])
def test_open_calls_do_not_depend_on_slices(spark, seed, slice_rows, fan):
    rng = random.Random(seed)
    rows = [(rng.choice("fg"), at, rng.choice(("call", "call", "resp", "resp", "other")), rng.choice("nm"), rng.choice((None, "", "a", "b"))) for at in range(300)]
    rows += [("h", at, "call" if at < 60 else "resp", "n", rng.choice((None, "a", "b", "c"))) for at in range(120)]
    df = spark.createDataFrame(rows, "g string, at long, kind string, name string, id string").repartition(4)
    out = pairing.latest_open_call(df, ["g"], "name", "at", F.col("kind") == "call", F.col("kind") == "resp", F.col("id"), F.col("at"),
                                   slice_rows=slice_rows, fan=fan)
    assert out.columns == [*df.columns, "matched"] and out.count() == len(rows)
    assert {(r.g, r["at"]): r.matched for r in out.collect() if r.matched is not None} == open_calls(rows)


def test_one_long_conversation_is_spread(spark):
    """A million turns of one file: calls nest 40 deep and cross the borders of slices."""
    at = F.col("id")
    rows = spark.range(1_000_000).select(F.lit("f").alias("g"), F.lit("n").alias("name"), at.alias("at"), (at % 80 < 40).alias("is_call"),
                                         F.when(at % 3 == 0, F.lit("same")).alias("id"))
    out = pairing.latest_open_call(rows, ["g"], "name", "at", F.col("is_call"), ~F.col("is_call"), F.col("id"), F.col("at"))
    left = out.where("NOT is_call")
    # Response number k of a run of 80 closes call number 79 - k of it.
    assert left.where("matched = at - 2 * (at % 80) + 79").count() == 500_000


def test_json_documents(spark):
    docs = ['{"a": 1, "api_key": "x", "b": {"token": {"c": [1, {"d": 2}]}, "ok": [true, null]}}', '{"input_tokens": 5, "max_tokens": "x"}',
            '"Authorization: Bearer abcdefgh12345678"', "[]", "not json", None, '{"password=abcd1234": 1}']
    got = [r[0] for r in spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").orderBy("i").select(redact_json(F.col("d"))).collect()]
    assert json.loads(got[0]) == {"a": 1, "api_key": "[redacted]", "b": {"token": "[redacted]", "ok": [True, None]}}
    assert json.loads(got[1]) == {"input_tokens": 5, "max_tokens": "[redacted]"}
    assert json.loads(got[2]) == "Authorization: Bearer [redacted]"
    assert got[3] == "[]" and got[4] is None and got[5] is None and got[6] is None


@pytest.mark.parametrize("depth", [0, 1, 4, 5, 12])
def test_encoded_boundaries_at_any_depth(spark, depth):
    text = "https://h.example/?x%" + "25" * depth + "26sig=abc123def"
    assert "abc123def" not in spark.range(1).select(redact_text(F.lit(text))).first()[0]


def test_manifest_finds_changes(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    listed = cases.write_case({"events": spark.range(7).select(F.col("id").alias("event_id"))}, folder)
    assert sum(r.row_count for r in listed.collect()) == 7
    held = listed.collect()
    spark.range(2).select(F.col("id").cast("string").alias("value")).write.mode("append").text(f"{folder}/events")
    listed = spark.createDataFrame(held, listed.schema)
    assert {r.problem for r in cases.manifest_problems(listed, cases.manifest(spark, folder, ["events"])).collect()} == {"unlisted"}


def test_selection_and_filters(spark):
    rows = spark.createDataFrame([("event",), ("finding",), ("summary",)], "record_type string")
    assert records.select_kinds(rows, ["event"]).count() == 2 and records.select_kinds(rows).count() == 3
    for bad in (["nothing"], []):
        with pytest.raises(ValueError):
            records.select_kinds(rows, bad)
    agents = spark.createDataFrame([("codex",), ("cursor",)], "source_agent string")
    assert contract.for_agents(agents, ["codex"]).count() == 1
    with pytest.raises(ValueError):
        contract.for_agents(agents, ["somebody"])
    words = spark.createDataFrame([(" Accept",), ("auto_accept",), ("modify",), ("reject",), ("x",), (None,)], "w string")
    assert [r[0] for r in words.select(otlp.call_decision(F.col("w"))).collect()] == ["allowed"] * 3 + ["denied", None, None]


def test_artifact_paths(spark):
    paths = {"/u/.claude/projects/p/a.jsonl": "claude-code", "/u/.claude/projects/p/subagents/workflows/w/journal.jsonl": None,
             "/u/Library/Application Support/Claude/local-agent-mode-sessions/s/audit.jsonl": "cowork", "/data/x.jsonl": "claude-code", "/data/x.txt": None}
    got = {r[0]: r[1] for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", lines.classify_path(F.col("p"))).collect()}
    assert got == paths and any("local-agent-mode-sessions" in r for r in lines.agent_roots("/Users/*"))


def test_lines_are_numbered_across_splits(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    with open(f"{folder}/a.jsonl", "w") as out:
        out.writelines(f"line {i} {'x' * 50}\n" for i in range(1, 2001))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows, notes = lines.numbered_lines(spark, folder)
        got = sorted((r.line, r.raw.split()[1]) for r in rows.collect())
        assert got == [(i, str(i)) for i in range(1, 2001)] and notes.count() == 0
        rows, notes = lines.numbered_lines(spark, folder, max_line_bytes=10)
        assert rows.count() == 0 and notes.count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_same_record_under_two_paths_counts_once(spark):
    rows = [("e1", 5, p, "https://a.example/x") for p in ("/a", "/b")] + [("e2", 6, "/a", "https://a.example/x")]
    df = spark.createDataFrame(rows, "event_id string, seq long, path string, url string").select(
        "event_id", "seq", "url", F.lit("codex").alias("source_agent"), F.lit("s").alias("session_id"), F.lit("/p").alias("project_path"),
        F.lit("2026-01-01T00:00:00Z").alias("timestamp"), F.lit("").alias("command"), F.lit("").alias("content_preview"),
        F.struct(F.col("path").alias("local_path"), F.lit(1).cast("bigint").alias("line")).alias("evidence"))
    assert {r["count"] for r in indicators.indicators(df).collect()} == {2}


def test_chain_may_deny(spark):
    chain = spark.createDataFrame([("r1", "e9", ["e1", "e9"], ("case", "codex"))],
                                  "rule_id string, final_event_id string, cited_event_ids array<string>, final_event struct<case_id:string,source_agent:string>")
    catalog = spark.createDataFrame([("r1", "1.0", 0, True)], "rule_id string, rule_version string, rule_pos int, enforce boolean")
    got = verdicts.verdicts(verdicts.chain_actions(chain, catalog), "run", enforce=True).collect()
    assert [(r.decision, r.deny_rule_id, r.case_id, r.action_event_ids) for r in got] == [("deny", "r1", "case", ["e9"])]


def test_oversize_records_need_a_place(spark):
    with pytest.raises(ValueError):
        jobs.deliver(spark.range(1), "/tmp/none", {}, max_bytes=10)


def test_container_options_with_values(spark):
    from actiontrail.operators import rules as R

    options = ("--ip 10.0.0.5", "--log-opt max-size=1m", "--mac-address 02:42:ac:11:00:02", "--cidfile /tmp/x", "--userns host",
               "--memory-swap 1g", "-e A=1 --label-file f", "--link db", "--storage-opt size=1G", "--volumes-from other")
    rule = next(r for r in R.load_rules() if r.id == "privilege.container_host_escape")
    rows = spark.createDataFrame([(f"{k}{i}", t) for i, o in enumerate(options) for k, t in (
        ("yes", f"docker run {o} --privileged alpine"), ("no", f"docker run {o} alpine --privileged"))], "id string, command string")
    hit = command_columns(rows).where(F.expr(rule.expr)).select("id").collect()
    assert sorted(r.id for r in hit) == sorted(f"yes{i}" for i in range(len(options)))


def test_companion_cases(spark, tmp_path):
    from actiontrail.operators import companions, rules as R

    (tmp_path / "a_tests.yaml").write_text("""
rule_id: exec.destructive_recursive_delete
cases:
  - {name: root, expect: match, events: [{event_type: command.exec, command: rm -rf /}]}
  - {name: inside if, expect: match, events: [{event_type: command.exec, command: "if true; then rm -rf /; fi"}]}
  - {name: quoted, expect: no_match, events: [{event_type: command.exec, command: "echo 'rm -rf /'"}]}
  - {name: wrong on purpose, expect: no_match, events: [{event_type: command.exec, command: rm -rf /}]}
""")
    (tmp_path / "b_tests.yaml").write_text("""
rule_id: chain.privilege_discovery_then_elevation
cases:
  - {name: in order, expect: match, events: [{event_type: command.exec, command: sudo -l}, {event_type: command.exec, command: sudo -i}]}
  - {name: first half, expect: no_match, events: [{event_type: command.exec, command: sudo -l}]}
  - {name: second half, expect: no_match, events: [{event_type: command.exec, command: sudo -i}]}
""")
    report = companions.case_report(spark, R.load_rules(), companions.load_cases(tmp_path)).collect()
    assert {(r.case_name, r.passed) for r in report} == {("root", True), ("inside if", True), ("quoted", True), ("wrong on purpose", False),
                                                         ("in order", True), ("first half", True), ("second half", True)}
    (tmp_path / "c_tests.yaml").write_text("rule_id: x\ncases: [{name: a, expect: maybe, events: [{}]}]")
    with pytest.raises(R.RuleError):
        companions.load_cases(tmp_path)
