"""Record selection, agent filters, document redaction, exports and command texts built from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from actiontrail.functions.commands import command_columns
from actiontrail.functions.redact import redact_json
from actiontrail.operators import cases, contract, findings, indicators
from actiontrail.operators.positions import number_in_order
from actiontrail.plans.adapters import ACTIONS_SQL, actions, spread, table
from actiontrail.plans.detect_queries import _MATCH_SQL, _matches
from actiontrail.plans.registry import ORACLES, query
from actiontrail.plans.stream_queries import WAIT_SECONDS, _folder, _stream
from actiontrail.sources import lines, otlp, records
from actiontrail.streaming import jobs
from actiontrail.streaming.sinks import CommittedSink

# --- command texts with the documents' own words ------------------------------

# (text, statements); w1 and w2 are the first two letters-only words of a document.
_W1 = "regexp_extract(text, '([A-Za-z]+)', 1)"
_TEMPLATES = (
    ("'grep -n ' || w || ' src.txt | wc -l > out.log'", "[('grep', '-n,' || w || ',src.txt', '', ''), ('wc', '-l', 'write:out.log', '')]", True),
    ("'if true; then sudo cat ' || w || '.md; fi'", "[('true', '', '', ''), ('cat', w || '.md', '', 'sudo')]", False),
    ("'for f in *; do rm -f ' || w || '; done'", "[('rm', '-f,' || w, '', '')]", False),
    ("'sh -c ''echo ' || w || ' && ls'''", "[('sh', '-c,echo ' || w || ' && ls', '', ''), ('echo', w, '', ''), ('ls', '', '', '')]", False),
    ("'cat <<E' || chr(10) || 'rm ' || w || chr(10) || 'E' || chr(10) || 'echo ' || w", "[('cat', '', 'here_doc:E', ''), ('echo', w, '', '')]", False),
    ("'echo ok; echo ''' || w", "[('echo', 'ok', '', '')]", False),
    ("repeat('true; ', 70) || 'rm -rf /' || w", "list_concat(list_transform(range(70), lambda i: ('true', '', '', '')), [('rm', '-rf,/' || w, '', '')])", False),
    ("'A=1 env B=2 nohup ' || w || ' -x'", "[(lower(w), '-x', '', 'env,nohup')]", True),
)
_CASE = "CASE doc_id % {n} {whens} END".format
_DOC_SQL = f"""
  d AS (SELECT doc_id, {_W1} AS w FROM documents WHERE {_W1} <> ''),
  c AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS nr, static FROM (SELECT doc_id,
    {_CASE(n=len(_TEMPLATES), whens=" ".join(f"WHEN {i} THEN {s}" for i, (_, s, _) in enumerate(_TEMPLATES)))} AS s,
    {_CASE(n=len(_TEMPLATES), whens=" ".join(f"WHEN {i} THEN {str(x).lower()}" for i, (_, _, x) in enumerate(_TEMPLATES)))} AS static FROM d))"""


@query("P33_document_commands", f"""
  WITH {_DOC_SQL}
  SELECT doc_id, CAST(nr AS BIGINT) AS statement_id, s[1] AS name, s[2] AS args, s[3] AS redirects, s[4] AS wrappers, static FROM c""")
def document_commands(spark, sf):
    """Names, operands, redirects, wrappers and the static mark of commands around each document's first word."""
    docs = table(spark, sf, "documents").withColumn("w", F.regexp_extract("text", "([A-Za-z]+)", 1)).where("w != ''")
    text = F.expr("CASE pmod(doc_id, {n}) {whens} END".format(n=len(_TEMPLATES), whens=" ".join(
        f"WHEN {i} THEN {t.replace(chr(39) * 2, chr(92) + chr(39))}" for i, (t, _, _) in enumerate(_TEMPLATES))))
    rows = command_columns(docs.select("doc_id", text.alias("command")))
    flat = rows.select("doc_id", "command_static", F.explode_outer("commands").alias("c")).where("c IS NOT NULL")
    return flat.select(
        "doc_id", F.col("c.statement_id").alias("statement_id"), F.col("c.name").alias("name"),
        F.array_join("c.operands", ",").alias("args"),
        F.array_join(F.transform("c.redirects", lambda r: F.concat(r["op"], F.lit(":"), r["target"])), ",").alias("redirects"),
        F.array_join("c.wrappers", ",").alias("wrappers"), F.col("command_static").alias("static"))


@query("P33_unread_parts", """
  WITH d AS (SELECT doc_id FROM documents WHERE regexp_extract(text, '([A-Za-z]+)', 1) <> '')
  SELECT doc_id, CASE doc_id % 8 WHEN 4 THEN 'here-document' WHEN 5 THEN 'unclosed quote' ELSE 'control flow' END AS note
  FROM d WHERE doc_id % 8 IN (1, 2, 4, 5)""")
def unread_parts(spark, sf):
    docs = table(spark, sf, "documents").withColumn("w", F.regexp_extract("text", "([A-Za-z]+)", 1)).where("w != ''")
    text = F.expr("CASE pmod(doc_id, {n}) {whens} END".format(n=len(_TEMPLATES), whens=" ".join(
        f"WHEN {i} THEN {t.replace(chr(39) * 2, chr(92) + chr(39))}" for i, (t, _, _) in enumerate(_TEMPLATES))))
    rows = command_columns(docs.select("doc_id", text.alias("command")))
    return rows.select("doc_id", F.explode_outer("command_notes").alias("note")).where("note IS NOT NULL")


# --- record selection and agents ----------------------------------------------


@query("F2_record_kinds", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'event' ELSE 'summary' END AS record_type FROM events WHERE event_id % 3 IN (0, 2)")
def record_kinds(spark, sf):
    kinds = F.element_at(F.array(F.lit("event"), F.lit("finding"), F.lit("summary")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = table(spark, sf, "events").select("event_id", kinds.alias("record_type"))
    return records.select_kinds(rows, ["event", "decision"])


@query("F7_agent_filter", f"SELECT event_id, source_agent FROM ({ACTIONS_SQL}) WHERE source_agent IN ('codex', 'cursor')")
def agent_filter(spark, sf):
    return contract.for_agents(actions(spark, sf), ["codex", "cursor"]).select("event_id", "source_agent")


@query("S1_page_artifacts", """
  SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'cowork' WHEN 2 THEN 'codex' WHEN 3 THEN NULL
    WHEN 4 THEN 'gemini-cli' ELSE 'claude-code' END AS agent FROM pages""")
def page_artifacts(spark, sf):
    """Artifact kinds of paths that end in the pages' own URL paths."""
    tail = F.regexp_replace(F.concat(F.col("page_id").cast("string"), F.lit("-"), F.regexp_replace("url", "[^A-Za-z0-9]", "_")), "^", "x")
    path = (F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("/home/u/.claude/projects/p/"), tail, F.lit(".jsonl")))
            .when(F.col("page_id") % 6 == 1, F.concat(F.lit("/Users/u/Library/Application Support/Claude/local-agent-mode-sessions/"), tail, F.lit("/audit.jsonl")))
            .when(F.col("page_id") % 6 == 2, F.concat(F.lit("/home/u/.codex/sessions/2026/rollout-"), tail, F.lit(".jsonl")))
            .when(F.col("page_id") % 6 == 3, F.concat(F.lit("/home/u/.claude/projects/p/subagents/workflows/"), tail, F.lit("/journal.jsonl")))
            .when(F.col("page_id") % 6 == 4, F.concat(F.lit("/home/u/.gemini/tmp/"), tail, F.lit("/logs.json")))
            .otherwise(F.concat(F.lit("/data/"), tail, F.lit(".jsonl"))))
    return table(spark, sf, "pages").select("page_id", lines.classify_path(path).alias("agent"))


@query("P10_call_decisions", """
  SELECT event_id, CASE event_type WHEN 'signup' THEN 'allowed' WHEN 'view' THEN 'allowed' WHEN 'click' THEN 'allowed'
    WHEN 'purchase' THEN 'denied' END AS decision FROM events""")
def call_decisions(spark, sf):
    word = (F.when(F.col("event_type") == "signup", " Accept ").when(F.col("event_type") == "view", "auto_accept")
            .when(F.col("event_type") == "click", "MODIFY").when(F.col("event_type") == "purchase", "reject").otherwise("later"))
    return table(spark, sf, "events").select("event_id", otlp.call_decision(word).alias("decision"))


@query("P16_json_documents", """
  SELECT event_id, '{"id":' || event_id || ',"user":{"api_key":"[redacted]","name":"n' || user_id || '"},"usage":{"input_tokens":' || user_id
    || ',"tokens":"[redacted]"},"list":["plain","https://h.example/?token=[redacted]"],"client_secret":"[redacted]","ok":true}' AS doc FROM events""")
def json_documents(spark, sf):
    """Documents with secret keys over strings and objects, token metrics and secret text in values."""
    doc = F.concat(F.lit('{"id":'), F.col("event_id"), F.lit(',"user":{"api_key":"k'), F.col("user_id"), F.lit('","name":"n'), F.col("user_id"),
                   F.lit('"},"usage":{"input_tokens":'), F.col("user_id"), F.lit(',"tokens":[1,2]},"list":["plain","https://h.example/?token='), F.col("event_id"),
                   F.lit('"],"client_secret":{"a":["b",{"c":'), F.col("user_id"), F.lit('}]},"ok":true}'))
    return spread(table(spark, sf, "events").select("event_id", "user_id")).select("event_id", redact_json(doc).alias("doc"))


# --- exports and links --------------------------------------------------------


@query("K4_case_manifest", f"""
  SELECT 'events' AS kind, count(*) AS row_count, 0 AS problems FROM ({ACTIONS_SQL})
  UNION ALL SELECT 'findings', count(*), 0 FROM ({_MATCH_SQL} SELECT event_id FROM hits)""")
def case_manifest(spark, sf):
    """Writes events and findings of a case and checks the manifest against what lies there."""
    folder = f"{_folder(spark)}/case"
    found = findings.from_matches(_matches(spark, sf), F.lit("2026-01-01T00:00:00Z"))
    listed = cases.publish_case({"events": actions(spark, sf), "findings": found}, folder, "case-1")
    bad = cases.verify_case(spark, folder, "case-1", ["events", "findings"])
    kind = F.element_at(F.split("path", "/"), -2)
    wrong = bad.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("bad"))
    return (listed.groupBy(kind.alias("kind")).agg(F.sum("row_count").alias("row_count")).join(wrong, "kind", "left")
            .select("kind", "row_count", F.coalesce("bad", F.lit(0)).cast("int").alias("problems")))


@query("O2_indicator_order", f"""
  SELECT row_number() OVER (ORDER BY type, value) AS place, type, value FROM ({ORACLES['A1_indicators_actions']})""")
def indicator_order(spark, sf):
    """Indicators numbered in export order, without a window over all of them."""
    found = indicators.indicators(actions(spark, sf)).select("type", "value")
    return number_in_order(found, ["type", "value"], "place")


@query("K2_K3_stream_fan_out", "SELECT sink, event_type, count(*) AS n FROM events, (SELECT unnest(['a', 'b']) AS sink) GROUP BY ALL")
def stream_fan_out(spark, sf):
    """Appended records reach every sink; records over a limit reach the sink for those."""
    out = _folder(spark)
    rows = _stream(spark, sf, "events").select(F.to_json(F.struct("event_id", "event_type")).alias("value"))
    sinks = {name: CommittedSink(f"{out}/{name}") for name in ("a", "b")}
    query_ = jobs.deliver(rows, f"{out}/checkpoint", sinks, max_bytes=1 << 20, oversize=CommittedSink(f"{out}/over"))
    if not query_.awaitTermination(WAIT_SECONDS):
        query_.stop()
        raise TimeoutError("stream did not reach the end of its input")
    both = [sink.read(spark, "value string").withColumn("sink", F.lit(n)) for n, sink in sinks.items()]
    return (both[0].unionByName(both[1]).select("sink", F.get_json_object("value", "$.event_type").alias("event_type"))
            .groupBy("sink", "event_type").agg(F.count(F.lit(1)).alias("n")))


