"""Contract, rules, chains, timelines, pairing, cases and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from actiontrail.functions.commands import command_columns, nested_pairs, pipeline_pairs as paired, statements
from actiontrail.operators import (cases, chains, contract, dedupe, findings, metrics, pairing,
                                   rules as R, summary, timeline, verdicts)
from actiontrail.plans.adapters import ACTIONS_SQL, COMMANDS, actions, table
from actiontrail.plans.registry import query
from actiontrail.schema import SEQ

# --- contract ----------------------------------------------------------------


def _faulty(spark, sf):
    """Actions with faults seeded by the row's position."""
    m = F.col(SEQ) % 12
    none = F.lit(None).cast("string")
    return actions(spark, sf).withColumns({
        "schema_version": F.when(m == 0, "0.1.0").otherwise(F.col("schema_version")),
        "event_type": F.when(m == 1, "shell.run").otherwise(F.col("event_type")),
        "confidence": F.when(m == 2, none).otherwise(F.col("confidence")),
        "decision": F.when(m == 3, "maybe").otherwise(F.col("decision")),
        "actor": F.when(m == 4, "robot").otherwise(F.col("actor")),
        "tags": F.when(m == 5, F.array(F.lit("a"), F.lit("a"), F.lit(" b"))).otherwise(F.col("tags")),
        "duration_ms": F.when(m == 6, F.lit(-1)).otherwise(F.col("duration_ms")).cast("bigint"),
        "exit_code": F.when(m == 7, F.lit(0)).otherwise(F.col("exit_code")).cast("int"),
        "diff_sha256": F.when(m == 8, "ABC").otherwise(F.col("diff_sha256"))})


@query("F1_contract_violations", f"""
  SELECT event_id, CASE seq % 12 WHEN 0 THEN 'schema_version' WHEN 1 THEN 'event_type'
     WHEN 2 THEN 'confidence' WHEN 3 THEN 'decision,column.decision' WHEN 4 THEN 'actor'
     WHEN 5 THEN 'tags.whitespace,tags.duplicate' WHEN 6 THEN 'duration_ms,column.duration_ms'
     WHEN 7 THEN 'column.exit_code' ELSE 'diff_sha256,column.diff_sha256' END AS violations
  FROM ({ACTIONS_SQL}) WHERE seq % 12 <= 8 AND NOT (seq % 12 = 3 AND event_type IN
     ('file.read', 'command.exec', 'network.indicator', 'permission.denied'))
  UNION ALL SELECT event_id, 'decision' FROM ({ACTIONS_SQL}) WHERE seq % 12 = 3 AND event_type IN
     ('file.read', 'command.exec', 'network.indicator', 'permission.denied')""")
def contract_violations(spark, sf):
    return contract.quarantine(_faulty(spark, sf)).select(
        "event_id", F.array_join("violations", ",").alias("violations"))


@query("F1_valid_events", f"SELECT event_id, file_path FROM ({ACTIONS_SQL}) WHERE seq % 12 > 8")
def valid_events(spark, sf):
    return contract.valid(_faulty(spark, sf)).select("event_id", "file_path")


@query("F3_capture_profile", f"""
  SELECT event_id, event_type, CAST(NULL AS VARCHAR) AS model FROM ({ACTIONS_SQL}) WHERE user_id % 3 <> 0""")
def capture_profile(spark, sf):
    user = F.substring("session_id", 2, 20).cast("bigint")
    rows = actions(spark, sf).withColumns({
        "event_type": F.when(user % 3 == 0, "message.reasoning").otherwise(F.col("event_type")),
        "model": F.lit("m-1")})
    return contract.capture_profile(rows, full=False).select("event_id", "event_type", "model")


# --- commands and rules ------------------------------------------------------


@query("P33_commands", f"""
  WITH parts AS (SELECT * FROM (VALUES {", ".join(
    f"('{c.replace(chr(39), chr(39) * 2)}', {i}, '{n}', {p}, {par})" for c, i, n, p, par in [
        (COMMANDS[0], 1, "ls", 0, 0), (COMMANDS[1], 1, "curl", 1, 0), (COMMANDS[1], 2, "bash", 1, 0),
        (COMMANDS[2], 1, "git", 0, 0), (COMMANDS[3], 1, "rm", 0, 0), (COMMANDS[4], 1, "echo", 1, 0),
        (COMMANDS[4], 2, "base64", 1, 0), (COMMANDS[4], 3, "sh", 1, 0), (COMMANDS[5], 1, "cat", 1, 0),
        (COMMANDS[5], 2, "curl", 1, 0), (COMMANDS[6], 1, "docker", 0, 0), (COMMANDS[7], 1, "kubectl", 0, 0),
        (COMMANDS[8], 1, "sudo", 0, 0), (COMMANDS[9], 1, "sudo", 0, 0), (COMMANDS[10], 1, "pytest", 0, 0),
        (COMMANDS[10], 2, "git", 0, 0), (COMMANDS[11], 1, "echo", 0, 0), (COMMANDS[12], 1, "ssh", 0, 0),
        (COMMANDS[13], 1, "claude", 0, 0), (COMMANDS[14], 1, "nmap", 0, 0), (COMMANDS[14], 2, "ls", 0, 0),
        (COMMANDS[15], 1, "curl", 0, 0), (COMMANDS[16], 1, "find", 0, 0), (COMMANDS[17], 1, "dig", 0, 0),
        (COMMANDS[17], 2, "whoami", 0, 1), (COMMANDS[18], 1, "python3", 0, 0), (COMMANDS[19], 1, "echo", 1, 0),
        (COMMANDS[19], 2, "tee", 1, 0)])}) AS v(command, statement_id, name, pipeline_id, parent_statement_id))
  SELECT event_id, CAST(statement_id AS BIGINT) AS statement_id, name,
    CAST(pipeline_id AS BIGINT) AS pipeline_id, CAST(parent_statement_id AS BIGINT) AS parent_statement_id
  FROM ({ACTIONS_SQL}) JOIN parts USING (command)""")
def commands(spark, sf):
    rows = command_columns(actions(spark, sf).select("event_id", "command"))
    return statements(rows).select("event_id", "statement_id", "name", "pipeline_id", "parent_statement_id")


@query("J6_pipeline_pairs", rf"""
  SELECT event_id, regexp_extract(command, '^(\w+)', 1) AS upstream,
    regexp_extract(command, '\| *(?:sudo )?([a-z0-9]+)', 1) AS downstream FROM ({ACTIONS_SQL})
  WHERE regexp_matches(command, '^[^'']*\|') AND command NOT LIKE '%base64%'
  UNION ALL SELECT event_id, unnest(['echo', 'echo', 'base64']), unnest(['base64', 'sh', 'sh'])
  FROM ({ACTIONS_SQL}) WHERE command LIKE '%base64%'""")
def pipeline_pairs(spark, sf):
    """Statements that feed later statements of their pipeline."""
    rows = command_columns(actions(spark, sf).select("event_id", "command"))
    return rows.select("event_id", F.explode_outer(paired(F.col("commands"))).alias("p")).where("p IS NOT NULL").select(
        "event_id", "p.upstream", "p.downstream")


@query("J7_nested_commands", f"""
  SELECT event_id, 'dig' AS outer_name, 'whoami' AS inner_name FROM ({ACTIONS_SQL}) WHERE command LIKE 'dig $(%'""")
def nested_commands(spark, sf):
    rows = command_columns(actions(spark, sf).select("event_id", "command"))
    return rows.select("event_id", F.explode_outer(nested_pairs(F.col("commands"))).alias("p")).where("p IS NOT NULL").select(
        "event_id", "p.outer_name", "p.inner_name")


# Raw-text shapes of the action commands, written for the oracle only.
_MATCH_SQL = rf"""
  WITH a AS ({ACTIONS_SQL}),
  hits AS (
    SELECT event_id, seq, 'exec.download_pipe_shell' AS rule_id FROM a WHERE regexp_matches(command, '^curl .*\| sudo bash')
    UNION ALL SELECT event_id, seq, 'integrity.git_hooks_bypass' FROM a WHERE command LIKE 'git commit%--no-verify'
    UNION ALL SELECT event_id, seq, 'exec.destructive_recursive_delete' FROM a WHERE command = 'rm -rf /'
    UNION ALL SELECT event_id, seq, 'exec.encoded_payload_shell' FROM a WHERE command LIKE '%base64 -d | sh'
    UNION ALL SELECT event_id, seq, 'exfil.env_capture_to_network' FROM a WHERE command LIKE 'cat /app/.env | curl -d @-%'
    UNION ALL SELECT event_id, seq, 'secrets.agent_read_env' FROM a WHERE command LIKE 'cat /app/.env%' OR file_path = '/app/.env'
    UNION ALL SELECT event_id, seq, 'privilege.container_host_escape' FROM a WHERE command LIKE '%--privileged%'
    UNION ALL SELECT event_id, seq, 'lateral.workload_exec' FROM a WHERE command LIKE 'kubectl%exec%'
    UNION ALL SELECT event_id, seq, 'recon.privilege_escalation' FROM a WHERE command = 'sudo -l' OR command LIKE 'find / -perm%'
    UNION ALL SELECT event_id, seq, 'privilege.elevated_shell' FROM a WHERE command = 'sudo -i'
    UNION ALL SELECT event_id, seq, 'exec.reverse_tunnel' FROM a WHERE command LIKE 'ssh -N -R%'
    UNION ALL SELECT event_id, seq, 'exec.agent_runtime_bypass_flags' FROM a WHERE command LIKE 'claude --dangerously%'
    UNION ALL SELECT event_id, seq, 'recon.network_sweep' FROM a WHERE command LIKE 'nmap -sn%'
    UNION ALL SELECT event_id, seq, 'exfil.dns_tunnel_exec' FROM a WHERE command LIKE 'dig $(%'
    UNION ALL SELECT event_id, seq, 'persistence.ssh_authorized_keys_command' FROM a WHERE command LIKE '%tee -a ~/.ssh/authorized_keys'
    UNION ALL SELECT event_id, seq, 'secrets.read_private_key' FROM a WHERE file_path LIKE '%/.ssh/id_rsa'
    UNION ALL SELECT event_id, seq, 'secrets.workload_identity_token_read' FROM a WHERE file_path LIKE '/var/run/secrets/%/token'
    UNION ALL SELECT event_id, seq, 'secrets.process_environment_read' FROM a WHERE file_path LIKE '/proc/%/environ'
    UNION ALL SELECT event_id, seq, 'recon.cloud_metadata' FROM a WHERE url LIKE 'http://169.254.169.254/%'
    UNION ALL SELECT event_id, seq, 'tamper.guardrails_off' FROM a WHERE elevated)
"""


def _matches(spark, sf):
    return R.matches(actions(spark, sf), R.load_rules())


@query("F4_rule_matches", _MATCH_SQL + "SELECT event_id, rule_id FROM hits")
def rule_matches(spark, sf):
    return _matches(spark, sf).select("event_id", "rule_id")


@query("A5_rule_counts", _MATCH_SQL + """
  SELECT rule_id, CASE WHEN rule_id IN ('exec.destructive_recursive_delete', 'persistence.ssh_authorized_keys_command')
      THEN 'critical' WHEN rule_id IN ('integrity.git_hooks_bypass', 'secrets.agent_read_env', 'lateral.workload_exec',
      'recon.privilege_escalation', 'recon.network_sweep', 'exfil.dns_tunnel_exec') THEN 'medium'
      WHEN rule_id = 'tamper.guardrails_off' THEN 'low' ELSE 'high' END AS severity, count(*) AS findings
  FROM hits GROUP BY rule_id""")
def rule_counts(spark, sf):
    return findings.counts_per_rule(_matches(spark, sf).select("rule_id", "severity"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The catalogue's own texts, for the oracle.
_CATALOG_SQL = "cat(rule_id, version, severity, title, tags) AS (VALUES " + ", ".join(
    f"({_quoted(r.id)}, {_quoted(r.version)}, {_quoted(r.severity)}, {_quoted(r.title)}, CAST([{', '.join(map(_quoted, r.tags))}] AS VARCHAR[]))"
    for r in R.load_rules()) + ")"
_SIZED = "repeat(chr(0), 7) || chr(CAST(strlen({0}) AS INT)) || {0}".format


@query("P18_findings", _MATCH_SQL + f""", {_CATALOG_SQL}
  SELECT a.event_id, 'fnd-' || substr(sha256({_SIZED('rule_id')} || {_SIZED('version')} || {_SIZED('a.event_id')}), 1, 24) AS finding_id,
    rule_id, version AS rule_version, severity, title, confidence, a."timestamp", a.session_id,
    'sha256:' || sha256(a.project_path) AS project_path_hash,
    array_to_string(list_sort(list_distinct(list_concat(tags, CASE WHEN a.elevated THEN ['permission_mode_elevated'] ELSE [] END))), ',') AS tags,
    regexp_replace(command, '(Bearer )[A-Za-z0-9]+', '\\1[redacted]') AS observed_command, file_path AS observed_file_path,
    coalesce(command LIKE '%Bearer%', false) OR coalesce(url LIKE '%hunter2%', false) AS redacted, local_path AS evidence_path
  FROM hits JOIN a USING (event_id) JOIN cat USING (rule_id)""")
def rendered_findings(spark, sf):
    """Rendered findings of every single-event match (ids, redaction, tags)."""
    out = findings.from_matches(_matches(spark, sf), F.lit("2026-01-01T00:00:00Z"))
    return out.select(
        F.col("cited_event_ids")[0].alias("event_id"), "finding_id", "rule_id", "rule_version", "severity", "title", "confidence", "timestamp",
        "session_id", "project_path_hash", F.array_join("tags", ",").alias("tags"), "observed_command", "observed_file_path", "redacted",
        F.col("evidence_refs")[0]["local_path"].alias("evidence_path"))


def _eligible(spark, sf):
    found = _matches(spark, sf)
    return found.withColumns({
        "eligible": F.col("severity").isin("critical", "high"),
        "finding_id": F.concat(F.lit("f-"), "event_id", F.lit("-"), "rule_id")})


@query("A8_policy_verdicts", _MATCH_SQL + """,
  ranked AS (SELECT h.*, list_position(['exec.agent_runtime_bypass_flags', 'exec.destructive_recursive_delete',
      'exec.download_pipe_shell', 'exec.encoded_payload_shell', 'exec.reverse_tunnel', 'exfil.dns_tunnel_exec',
      'exfil.env_capture_to_network', 'integrity.git_hooks_bypass', 'lateral.workload_exec',
      'persistence.ssh_authorized_keys_command', 'privilege.container_host_escape', 'privilege.elevated_shell',
      'recon.cloud_metadata', 'recon.network_sweep', 'recon.privilege_escalation', 'secrets.agent_read_env',
      'secrets.process_environment_read', 'secrets.read_private_key', 'secrets.workload_identity_token_read',
      'tamper.guardrails_off'], rule_id) AS pos,
      rule_id NOT IN ('integrity.git_hooks_bypass', 'secrets.agent_read_env', 'lateral.workload_exec',
      'recon.privilege_escalation', 'recon.network_sweep', 'exfil.dns_tunnel_exec', 'tamper.guardrails_off') AS eligible
    FROM hits h)
  SELECT event_id, CASE WHEN bool_or(eligible) THEN 'deny' ELSE 'no_override' END AS decision,
    CASE WHEN bool_or(eligible) THEN 'enforce_rule_match' ELSE 'no_enforce_eligible_match' END AS reason,
    string_agg(rule_id, ',' ORDER BY pos) AS rule_ids, arg_min(rule_id, pos) FILTER (WHERE eligible) AS deny_rule_id
  FROM ranked GROUP BY event_id""")
def policy_verdicts(spark, sf):
    out = verdicts.verdicts(_eligible(spark, sf), "run-1", enforce=True)
    return out.select(F.col("action_event_ids")[0].alias("event_id"), "decision", "reason",
                      F.array_join("rule_ids", ",").alias("rule_ids"), "deny_rule_id")


@query("J8_catalog_overlay", """
  WITH b AS (SELECT n_name AS rule_id, CAST(n_nationkey AS INT) AS rule_pos FROM nation),
  o AS (SELECT CASE WHEN r_regionkey % 2 = 0 THEN (SELECT n_name FROM nation WHERE n_nationkey = r_regionkey)
     ELSE r_name || '-new' END AS rule_id, CAST(r_regionkey AS INT) AS rule_pos FROM region)
  SELECT rule_id, rule_pos, 'builtin' AS layer FROM b WHERE rule_id NOT IN (SELECT rule_id FROM o)
  UNION ALL SELECT o.rule_id, CAST(coalesce(b.rule_pos, (SELECT max(rule_pos) + 1 FROM b) + o.rule_pos) AS INT), 'operator'
  FROM o LEFT JOIN b USING (rule_id)""")
def catalog_overlay(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    builtin = n.select(F.col("n_name").alias("rule_id"), F.col("n_nationkey").cast("int").alias("rule_pos"))
    named = r.join(n, r["r_regionkey"] == n["n_nationkey"])
    ours = named.select(F.when(F.col("r_regionkey") % 2 == 0, F.col("n_name")).otherwise(
        F.concat("r_name", F.lit("-new"))).alias("rule_id"), F.col("r_regionkey").cast("int").alias("rule_pos"))
    return R.overlay_frames(builtin, ours)


@query("J12_rule_expectations", _MATCH_SQL + """,
  want AS (SELECT 'secrets.agent_read_env' AS rule_id, event_id AS case_name,
    CASE WHEN file_path LIKE '/app/%' THEN 'match' ELSE 'no_match' END AS expect FROM a WHERE file_path IS NOT NULL)
  SELECT w.rule_id, w.case_name, w.expect, CASE WHEN h.event_id IS NULL THEN 'no_match' ELSE 'match' END AS got,
    w.expect = (CASE WHEN h.event_id IS NULL THEN 'no_match' ELSE 'match' END) AS passed
  FROM want w LEFT JOIN hits h ON h.event_id = w.case_name AND h.rule_id = w.rule_id""")
def rule_expectations(spark, sf):
    want = actions(spark, sf).where(F.col("file_path").isNotNull()).select(
        F.lit("secrets.agent_read_env").alias("rule_id"), F.col("event_id").alias("case_name"),
        F.when(F.col("file_path").startswith("/app/"), "match").otherwise("no_match").alias("expect"))
    got = _matches(spark, sf).select("rule_id", F.col("event_id").alias("case_name"))
    return R.expectation_report(want, got)


# --- chains ------------------------------------------------------------------

_NUMBERED = """
  WITH n AS (SELECT 'evt-' || event_id AS id, event_id AS seq, user_id, event_type, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events)"""


def _chain_rows(spark, sf):
    """The actions as step material; one group per user."""
    return actions(spark, sf).withColumns({
        "source_type": F.lit("hook"), "source_agent": F.lit("codex"), "project_path": F.lit(None).cast("string")})


# The action type each raw event kind is read as.
_KINDS = {"signup": "config.agent", "view": "file.read", "click": "network.indicator",
          "purchase": "command.exec", "error": "permission.denied"}


def _is(kind):
    return F.col("event_type") == _KINDS[kind]


def _chain_query(spark, sf, *rules, capped=True, **kw):
    found = chains.chain_matches(_chain_rows(spark, sf), list(rules), capped=capped, **kw)
    return found.select("rule_id", F.array_join("cited_event_ids", ",").alias("chain"))


@query("W6_W7_chain_2step", _NUMBERED + """
  SELECT 'two' AS rule_id, id1 || ',' || id AS chain FROM (
    SELECT f.id, f.user_id, f.pos, arg_min(a.id, a.pos) AS id1 FROM n f JOIN n a ON a.user_id = f.user_id
      AND a.event_type = 'signup' AND a.pos BETWEEN f.pos - 9 AND f.pos - 1
    WHERE f.event_type = 'purchase' GROUP BY ALL)""")
def chain_2step(spark, sf):
    return _chain_query(spark, sf, chains.ChainRule("two", (_is("signup"), _is("purchase")), within_events=10),
                        capped=False)


_THREE = """,
  firsts AS (SELECT f.id, f.user_id, f.pos, arg_min(a.id, a.pos) AS id1, min(a.pos) AS p1 FROM n f
    JOIN n a ON a.user_id = f.user_id AND a.event_type = 'signup' AND a.pos BETWEEN f.pos - 19 AND f.pos - 1
    WHERE f.event_type = 'purchase' GROUP BY ALL),
  seconds AS (SELECT x.id, x.user_id, x.pos, x.id1, arg_min(b.id, b.pos) AS id2, min(b.pos) AS p2 FROM firsts x
    JOIN n b ON b.user_id = x.user_id AND b.event_type = 'view' AND b.pos > x.p1 AND b.pos < x.pos GROUP BY ALL)"""


@query("W6_chain_3step", _NUMBERED + _THREE + """
  SELECT 'three' AS rule_id, id1 || ',' || id2 || ',' || id AS chain FROM seconds""")
def chain_3step(spark, sf):
    return _chain_query(spark, sf, chains.ChainRule(
        "three", (_is("signup"), _is("view"), _is("purchase")), within_events=20), capped=False)


@query("W9_chain_max_matches", _NUMBERED + _THREE + """
  SELECT 'three' AS rule_id, id1 || ',' || id2 || ',' || id AS chain FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS rn FROM seconds) WHERE rn <= 2""")
def chain_max_matches(spark, sf):
    return _chain_query(spark, sf, chains.ChainRule(
        "three", (_is("signup"), _is("view"), _is("purchase")), within_events=20, max_matches=2))


@query("W8_W13_chain_time", _NUMBERED + """
  SELECT 'timed' AS rule_id, id1 || ',' || id AS chain FROM (
    SELECT f.id, f.user_id, f.pos, arg_min(a.id, a.pos) AS id1 FROM n f JOIN n a ON a.user_id = f.user_id
      AND a.event_type = 'error' AND a.pos BETWEEN f.pos - 256 AND f.pos - 1
      AND f.us - a.us BETWEEN 0 AND 86400000000
    WHERE f.event_type = 'click' GROUP BY ALL)""")
def chain_time(spark, sf):
    return _chain_query(spark, sf, chains.ChainRule("timed", (_is("error"), _is("click")),
                                                    within_seconds=86_400), capped=False)


@query("W8_chain_far_back", _NUMBERED + """
  SELECT 'far' AS rule_id, id1 || ',' || id AS chain FROM (
    SELECT f.id, f.user_id, f.pos, arg_min(a.id, a.pos) AS id1 FROM n f JOIN n a ON a.user_id = f.user_id
      AND a.event_type = 'error' AND a.pos < f.pos AND f.us - a.us BETWEEN 0 AND 864000000000
    WHERE f.event_type = 'click' GROUP BY ALL)""")
def chain_far_back(spark, sf):
    """A rule of ten days alone, over however many events these hold."""
    return _chain_query(spark, sf, chains.ChainRule("far", (_is("error"), _is("click")), within_seconds=864_000),
                        capped=False, look_back=None)


@query("W10_chain_duplicate_ids", _NUMBERED + """
  SELECT 'two' AS rule_id, id1 || ',' || id AS chain FROM (
    SELECT f.id, f.user_id, f.pos, arg_min(a.id, a.pos) AS id1 FROM n f JOIN n a ON a.user_id = f.user_id
      AND a.event_type = 'signup' AND a.pos BETWEEN f.pos - 9 AND f.pos - 1
    WHERE f.event_type = 'purchase' GROUP BY ALL)""")
def chain_duplicates(spark, sf):
    rows = _chain_rows(spark, sf)
    again = rows.withColumn(SEQ, F.col(SEQ) + 1_000_000_000_000)
    found = chains.chain_matches(rows.unionByName(again), [chains.ChainRule(
        "two", (_is("signup"), _is("purchase")), within_events=10)], capped=False)
    return found.select("rule_id", F.array_join("cited_event_ids", ",").alias("chain"))


def _builtin_chains(spark, sf):
    rules = [r for r in R.load_rules() if r.steps]
    view = R.rule_view(actions(spark, sf), texts=R.step_texts(rules))
    return chains.chain_matches(view, R.chain_rules(rules)), R.catalog_frame(spark, rules)


def _steps_sql(first: bool) -> str:
    """The two steps of each shipped chain over the action texts, for the oracle."""
    rules = (
        ("permission_denied_then_runtime_bypass", 16, "event_type = 'permission.denied'", "command LIKE 'claude --dangerously%'"),
        ("privilege_discovery_then_elevation", 32, "command = 'sudo -l' OR command LIKE 'find / -perm%'", "command = 'sudo -i'"),
        ("workload_identity_then_lateral_execution", 32, "file_path LIKE '/var/run/secrets/%/token'", "command LIKE 'kubectl%exec%'"),
        ("guardrails_off_then_egress", 64, "elevated", # Short data options compare without case, so `-fsSL` counts as `-F`.
         "command LIKE '%| curl -d @-%' OR command LIKE 'curl -H %Bearer%' OR command LIKE 'curl -fsSL %'"))
    return " UNION ALL ".join(
        f"SELECT 'chain.{name}' AS rule_id, {k} AS k, user_id, pos, event_id FROM n WHERE {one if first else two}"
        for name, k, one, two in rules)


@query("W6_builtin_chains", f"""
  WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS pos FROM ({ACTIONS_SQL})),
  s1 AS ({_steps_sql(True)}), s2 AS ({_steps_sql(False)}),
  pairs AS (SELECT s2.rule_id, s2.user_id, s2.pos, s2.event_id AS final_event_id, arg_min(s1.event_id, s1.pos) AS id1
    FROM s2 JOIN s1 ON s1.rule_id = s2.rule_id AND s1.user_id = s2.user_id AND s1.pos BETWEEN s2.pos - (s2.k - 1) AND s2.pos - 1
    GROUP BY ALL)
  SELECT rule_id, final_event_id, id1 || ',' || final_event_id AS chain FROM (
    SELECT *, row_number() OVER (PARTITION BY rule_id, user_id ORDER BY pos) AS rn FROM pairs) WHERE rn = 1""")
def builtin_chains(spark, sf):
    found, _ = _builtin_chains(spark, sf)
    return found.select("rule_id", "final_event_id", F.array_join("cited_event_ids", ",").alias("chain"))


@query("A6_A7_chain_findings", f"""
  WITH {_CATALOG_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS pos FROM ({ACTIONS_SQL})),
  s1 AS ({_steps_sql(True)}), s2 AS ({_steps_sql(False)}),
  pairs AS (SELECT s2.rule_id, s2.user_id, s2.pos, s2.event_id AS id2, arg_min(s1.event_id, s1.pos) AS id1
    FROM s2 JOIN s1 ON s1.rule_id = s2.rule_id AND s1.user_id = s2.user_id AND s1.pos BETWEEN s2.pos - (s2.k - 1) AND s2.pos - 1
    GROUP BY ALL),
  one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, user_id ORDER BY pos) AS rn FROM pairs) WHERE rn = 1)
  SELECT 'fnd-' || substr(sha256({_SIZED('rule_id')} || {_SIZED('version')} || {_SIZED('id1')} || {_SIZED('id2')}), 1, 24) AS finding_id, rule_id,
    CASE WHEN 'low' IN (a.confidence, b.confidence) THEN 'low' WHEN 'medium' IN (a.confidence, b.confidence) THEN 'medium' ELSE 'high' END AS confidence,
    array_to_string(list_sort(list_distinct(list_concat(cat.tags, CASE WHEN a.elevated OR b.elevated THEN ['permission_mode_elevated'] ELSE [] END))), ',') AS tags,
    id1 || ',' || id2 AS cited, coalesce(b.command LIKE '%Bearer%', false) AS redacted, 'sha256:' || sha256(b.project_path) AS project_path_hash
  FROM one JOIN n a ON a.event_id = id1 JOIN n b ON b.event_id = id2 JOIN cat USING (rule_id)""")
def chain_findings(spark, sf):
    """Every event arrives a second time later on; a chain still gives one finding."""
    rules = [r for r in R.load_rules() if r.steps]
    rows = actions(spark, sf)
    again = rows.withColumn(SEQ, F.col(SEQ) + 1_000_000_000_000)
    found = chains.chain_matches(R.rule_view(rows.unionByName(again), texts=R.step_texts(rules)), R.chain_rules(rules))
    catalog = R.catalog_frame(spark, rules)
    return findings.from_chains(found, catalog, F.lit("2026-01-01T00:00:00Z")).select(
        "finding_id", "rule_id", "confidence", F.array_join("tags", ",").alias("tags"),
        F.array_join("cited_event_ids", ",").alias("cited"), "redacted", "project_path_hash")


@query("A6_weakest_confidence", """
  SELECT l_orderkey, CASE min(CASE l_linenumber % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 1 END)
    WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence FROM lineitem GROUP BY l_orderkey""")
def weakest_confidence(spark, sf):
    level = (F.when(F.col("l_linenumber") % 4 <= 1, "high").when(F.col("l_linenumber") % 4 == 2, "medium")
             .otherwise("odd"))
    # An order has at most seven lines, as a chain has at most eight links.
    links = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(level).alias("levels"))
    return links.select("l_orderkey", findings.weakest_confidence(F.col("levels")).alias("confidence"))


# --- timelines ---------------------------------------------------------------


@query("A2_session_rollup", f"""
  SELECT source_agent, source_type, session_id, '' AS boundary, min(project_path) AS project_path,
    min("timestamp") AS start, max("timestamp") AS "end", count(*) AS event_count
  FROM ({ACTIONS_SQL}) GROUP BY ALL""")
def session_rollup(spark, sf):
    return timeline.session_rollup(actions(spark, sf))


@query("O1_session_order", f"""
  SELECT session_id, min("timestamp") AS start FROM ({ACTIONS_SQL})
  GROUP BY source_agent, source_type, session_id""")
def session_order(spark, sf):
    return timeline.session_order(timeline.session_rollup(actions(spark, sf))).select("session_id", "start")


@query("W1_ordered_events", f"""
  SELECT event_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY "timestamp", seq) AS step
  FROM ({ACTIONS_SQL})""")
def ordered_events(spark, sf):
    return timeline.ordered_events(actions(spark, sf)).select("event_id", "session_id", "step")


@query("K5_timeline_pages", f"""
  SELECT session_id, CAST((step - 1) // 20 AS BIGINT) AS page, count(*) AS events,
    string_agg(event_id, ',' ORDER BY step) AS ids
  FROM (SELECT event_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY "timestamp", seq) AS step
    FROM ({ACTIONS_SQL})) GROUP BY ALL""")
def timeline_pages(spark, sf):
    pages = timeline.timeline_pages(actions(spark, sf), page_rows=20)
    return pages.select("session_id", "page", F.size("events").cast("bigint").alias("events"),
                        F.array_join(F.transform("events", lambda e: e["event_id"]), ",").alias("ids"))


@query("W2_W3_carry_forward", """
  SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN 'dir-' || length(text) END IGNORE NULLS)
    OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS cwd FROM conversations""")
def carry_forward(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.when(
        F.col("turn") % 3 == 0, F.concat(F.lit("dir-"), F.length("text").cast("string"))).alias("cwd"))
    return timeline.carry_forward(rows, ["cwd"], ["conv_id"], "turn")


@query("W4_mode_change", """
  SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p
    FROM events) WHERE p IS NULL OR p <> event_type""")
def mode_change(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return timeline.changes_only(rows, "event_type", ["user_id"], "event_id")


@query("W5_session_bookends", """
  SELECT conv_id, 'start' AS edge, min(turn) FILTER (WHERE turn >= 1) AS line FROM conversations
    GROUP BY conv_id HAVING max(turn) >= 1
  UNION ALL SELECT conv_id, 'end', max(turn) FROM conversations GROUP BY conv_id HAVING max(turn) >= 1""")
def session_bookends(spark, sf):
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") >= 1, F.col("conv_id").cast("string")).alias("sid"),
        F.col("turn").cast("string").alias("ts"), F.col("turn").alias("line"), "role")
    start, end = timeline.bookends(rows, ["conv_id"], "turn", "sid", ["role"], "ts", "line")
    return (start.select("conv_id", F.lit("start").alias("edge"), "line")
            .unionByName(end.select("conv_id", F.lit("end").alias("edge"), "line")))


# --- pairing -----------------------------------------------------------------


@query("J1_call_owner", """
  SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (
    PARTITION BY conv_id, turn % 4 // 2 ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner
  FROM conversations""")
def call_owner(spark, sf):
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.floor(F.col("turn") % 4 / 2).alias("call_id"))
    return pairing.earlier_owner(rows, ["conv_id"], "call_id", "turn", F.when(
        F.col("role") == "user", F.col("turn")), "owner").select("conv_id", "turn", "owner")


@query("J2_as_of_unmatched", """
  WITH RECURSIVE n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
    FROM events WHERE event_type IN ('view', 'purchase')),
  w AS (SELECT user_id, rn, event_id, event_type, CASE WHEN event_type = 'view' THEN [event_id] ELSE CAST([] AS BIGINT[]) END AS stack,
      CAST(NULL AS BIGINT) AS matched FROM n WHERE rn = 1
    UNION ALL SELECT n.user_id, n.rn, n.event_id, n.event_type,
      CASE WHEN n.event_type = 'view' THEN list_append(w.stack, n.event_id) ELSE w.stack[1:len(w.stack) - 1] END,
      CASE WHEN n.event_type = 'purchase' THEN w.stack[len(w.stack)] END
    FROM w JOIN n ON n.user_id = w.user_id AND n.rn = w.rn + 1)
  SELECT user_id, event_id, matched FROM w WHERE event_type = 'purchase'""")
def as_of_unmatched(spark, sf):
    """Each purchase closes the latest open view of its user; brute force in tests."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.lit("n").alias("name"))
    out = pairing.as_of_unmatched(rows, ["user_id"], "name", "event_id", F.col("event_type") == "view",
                                  F.col("event_type") == "purchase", F.col("event_id"))
    return out.where(F.col("event_type") == "purchase").select("user_id", "event_id", "matched")


@query("J2_open_calls_with_ids", """
  WITH RECURSIVE n AS (SELECT user_id, event_id, event_type = 'purchase' AS answer,
      CASE WHEN event_type = 'view' AND event_id % 3 > 0 OR event_type = 'purchase' AND event_id % 2 > 0 THEN CAST(event_id // 7 % 3 AS VARCHAR) END AS id,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
    FROM events WHERE event_type IN ('view', 'purchase')),
  w AS (SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, false AS answer, CAST([] AS STRUCT(e BIGINT, id VARCHAR)[]) AS stack, CAST(NULL AS BIGINT) AS matched
      FROM n WHERE rn = 1
    UNION ALL SELECT s.user_id, s.rn, s.event_id, s.answer,
      CASE WHEN NOT s.answer THEN list_append(s.stack, {'e': s.event_id, 'id': s.id}) WHEN s.hit IS NULL THEN s.stack
        ELSE list_concat(s.stack[1:s.hit - 1], s.stack[s.hit + 1:]) END,
      CASE WHEN s.answer THEN s.stack[s.hit].e END
    FROM (SELECT n.*, w.stack, list_max(list_filter(range(1, len(w.stack) + 1), lambda i: w.stack[i].id IS NULL OR n.id IS NULL OR w.stack[i].id = n.id)) AS hit
          FROM w JOIN n ON n.user_id = w.user_id AND n.rn = w.rn + 1) AS s)
  SELECT user_id, event_id, matched FROM w WHERE answer""")
def open_calls_with_ids(spark, sf):
    """Each purchase closes the latest open view of its user; ids stand on some rows of both kinds and have to agree where both have one."""
    kind, e = F.col("event_type"), F.col("event_id")
    has = ((kind == "view") & (e % 3 > 0)) | ((kind == "purchase") & (e % 2 > 0))
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.lit("n").alias("name"),
                                             F.when(has, (F.floor(e / 7) % 3).cast("string")).alias("id"))
    out = pairing.latest_open_call(rows, ["user_id"], "name", "event_id", kind == "view", kind == "purchase", F.col("id"), F.col("event_id"))
    return out.where(kind == "purchase").select("user_id", "event_id", "matched")


@query("J3_late_failure", """
  WITH r AS (SELECT user_id, event_id FROM events WHERE event_type = 'purchase'),
  f AS (SELECT user_id, event_id AS fail FROM events WHERE event_type = 'error'),
  hit AS (SELECT DISTINCT user_id, coalesce(b, a) AS event_id FROM (
    SELECT f.user_id, f.fail, max(r.event_id) FILTER (WHERE r.event_id < f.fail) AS b,
      min(r.event_id) FILTER (WHERE r.event_id > f.fail) AS a FROM f JOIN r USING (user_id) GROUP BY ALL))
  SELECT r.user_id, r.event_id, hit.event_id IS NOT NULL AS failed_late FROM r LEFT JOIN hit
    ON hit.user_id = r.user_id AND hit.event_id = r.event_id""")
def late_failure(spark, sf):
    e = table(spark, sf, "events")
    pick = lambda k: e.where(F.col("event_type") == k).select("user_id", "event_id")
    return pairing.tag_nearest(pick("purchase"), pick("error"), ["user_id"], "event_id").select(
        "user_id", "event_id", "failed_late")


@query("J4_explicit_prompts", """
  SELECT conv_id, turn FROM conversations c WHERE NOT (turn % 2 = 1 AND EXISTS (
    SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND length(d.text) > 900))""")
def explicit_prompts(spark, sf):
    rows = table(spark, sf, "conversations")
    return pairing.prefer_explicit(rows, ["conv_id"], F.length("text") > 900, F.col("turn") % 2 == 1).select(
        "conv_id", "turn")


@query("J5_fork_boundary", """
  SELECT conv_id, turn FROM conversations c WHERE turn >= coalesce((SELECT min(turn) FROM conversations d
    WHERE d.conv_id = c.conv_id AND length(d.text) > 600), 0)""")
def fork_boundary(spark, sf):
    return pairing.from_boundary(table(spark, sf, "conversations"), ["conv_id"],
                                 F.length("text") > 600, "turn").select("conv_id", "turn")


@query("J14_decision_link", f"""
  SELECT d.event_id AS denied, min(c.event_id) AS command_event FROM ({ACTIONS_SQL}) d JOIN ({ACTIONS_SQL}) c
    ON d.source_agent = c.source_agent AND d.session_id = c.session_id AND d.k = c.k
  WHERE d.event_type = 'permission.denied' AND c.event_type = 'command.exec' GROUP BY d.event_id""")
def decision_link(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias(SEQ), F.regexp_extract(
        "props", "([0-9]+)", 1).alias("call"))
    a = actions(spark, sf).join(e, SEQ).withColumn("tool_call_id", F.col("call"))
    return pairing.decision_links(a).where(F.col("decided") == "permission.denied").where("call_event IS NOT NULL").select(
        F.col("decision_event").alias("denied"), F.col("call_event").alias("command_event"))


# --- dedupe, cases, reports --------------------------------------------------


def _copies(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    again = e.where(F.col("event_id") % 3 == 0).withColumn(
        "value", F.when(F.col("event_id") % 6 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return e.withColumn("pos", F.col("event_id")).unionByName(again.withColumn("pos", F.col("event_id") + 10_000_000))


@query("W11_first_per_id", "SELECT event_id, user_id, value FROM events")
def first_per_id(spark, sf):
    rows = _copies(spark, sf).withColumn("event_id", F.col("event_id").cast("string"))
    return dedupe.first_per_id(rows, "event_id", "pos").select(
        F.col("event_id").cast("bigint").alias("event_id"), "user_id", "value")


@query("W12_upsert", """
  SELECT event_id, CASE WHEN event_id % 6 = 0 THEN value + 1 ELSE value END AS value, value AS first_value,
    CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS versions FROM events""")
def upsert(spark, sf):
    rows = _copies(spark, sf).withColumn("first_value", F.col("value"))
    out = dedupe.upsert(rows, "event_id", "pos", last=["value"], first=["first_value"])
    return out.withColumn("versions", F.col("versions").cast("int"))


@query("A11_conflicts", "SELECT event_id, CAST(2 AS BIGINT) AS copies FROM events WHERE event_id % 6 = 0")
def conflicts(spark, sf):
    return dedupe.conflicts(_copies(spark, sf), "event_id", ["pos"])


def _cited(spark, sf):
    e = table(spark, sf, "events")
    return e.where(F.col("event_type") == "purchase").select(
        F.concat(F.lit("case-"), (F.col("user_id") % 10).cast("string")).alias("case_id"),
        F.array(F.concat(F.lit("evt-"), F.col("event_id").cast("string")),
                F.concat(F.lit("evt-"), (F.col("event_id") * 2).cast("string"))).alias("cited_event_ids"))


@query("J9_cited_events", """
  SELECT 'evt-' || e.event_id AS event_id FROM events e WHERE event_type = 'purchase' OR event_id IN (
    SELECT event_id * 2 FROM events WHERE event_type = 'purchase')""")
def cited_events(spark, sf):
    return cases.cited_events(actions(spark, sf), _cited(spark, sf)).select("event_id")


@query("U3_missing_citations", """
  SELECT DISTINCT 'evt-' || (event_id * 2) AS event_id FROM events WHERE event_type = 'purchase'
    AND event_id * 2 NOT IN (SELECT event_id FROM events)""")
def missing_citations(spark, sf):
    return cases.missing_citations(actions(spark, sf), _cited(spark, sf))


@query("J10_digest_drift", """
  SELECT 'd' || doc_id AS local_path, sha256(text) AS current_sha256 FROM documents WHERE doc_id % 4 = 0""")
def digest_drift(spark, sf):
    d = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("local_path"), "doc_id", "text")
    now = d.select("local_path", F.sha2("text", 256).alias("sha256"))
    old = d.where(F.col("doc_id") % 4 == 0).select("local_path", F.sha2(F.upper(F.concat("text", F.lit("!"))), 256).alias("sha256"))
    return cases.digest_drift(now.unionByName(old), now)


@query("J11_manifest_diff", """
  SELECT 'd' || doc_id AS path, CASE doc_id % 8 WHEN 0 THEN 'missing' WHEN 1 THEN 'unlisted'
    WHEN 2 THEN 'digest_mismatch' ELSE 'row_count_mismatch' END AS problem FROM documents WHERE doc_id % 8 < 4""")
def manifest_diff(spark, sf):
    m = F.col("doc_id") % 8
    d = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "doc_id",
        F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("row_count"))
    listed = d.where(m != 1)
    found = d.where(m != 0).withColumns({
        "sha256": F.when(m == 2, F.reverse("sha256")).otherwise(F.col("sha256")),
        "row_count": F.when(m == 3, F.col("row_count") + 1).otherwise(F.col("row_count"))})
    return cases.manifest_problems(listed, found)


@query("O3_K4_case_bundle", f"""
  SELECT event_id, "timestamp" FROM ({ACTIONS_SQL}) WHERE seq IN (
    SELECT event_id FROM events WHERE event_type = 'purchase' AND user_id % 10 = 3
    UNION SELECT event_id * 2 FROM events WHERE event_type = 'purchase' AND user_id % 10 = 3)""")
def case_bundle(spark, sf):
    f = _cited(spark, sf).withColumns({
        "finding_id": F.concat_ws("-", "cited_event_ids"), "timestamp": F.lit(None).cast("string"),
        SEQ: F.xxhash64("cited_event_ids")})
    none = f.select("case_id", "timestamp", SEQ, F.lit("enf").alias("decision_id")).where(F.lit(False))
    parts = cases.case_records(actions(spark, sf), f, none, "case-3", SEQ)
    return parts["events"].select("event_id", "timestamp")


@query("A3_run_summary", f"""
  WITH a AS ({ACTIONS_SQL})
  SELECT 'partial' AS status, (SELECT count(*) FROM documents WHERE n_chars > 100) AS artifacts_scanned,
    (SELECT count(*) FROM a WHERE seq % 12 > 8) AS events_emitted,
    (SELECT count(*) FROM a WHERE command = 'rm -rf /' AND seq % 12 > 8) AS findings_emitted, CAST(0 AS BIGINT) AS indicators_emitted,
    (SELECT count(*) FROM a WHERE seq % 12 <= 8) AS diagnostics""")
def run_summary(spark, sf):
    good, bad = contract.valid(_faulty(spark, sf)), contract.quarantine(_faulty(spark, sf))
    docs = table(spark, sf, "documents")
    counts = summary.kind_counts(
        event=good, diagnostic=bad, finding=good.where(F.col("command") == "rm -rf /"),
        artifact_parsed=docs.where("n_chars > 100"), artifact_failed=docs.where("n_chars <= 100").unionByName(
            docs.where("doc_id = 0")))
    return summary.run_summary(counts)


@query("A4_S7_metric_rollup", """
  SELECT 'tool_calls_' || event_type AS name,
    '{"k":"' || (k % 5) || '","service.name":"agent-' || (user_id % 3) || '"}' AS labels,
    round(sum(CASE WHEN value <> 0 THEN value ELSE 1 END), 4) AS value
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) GROUP BY ALL""")
def metric_rollup(spark, sf):
    text = lambda c: c.cast("string")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    raw = table(spark, sf, "events").select(
        F.concat(F.lit("tool.calls-"), "event_type").alias("name"),
        F.create_map(F.lit("service.name"), F.concat(F.lit("agent-"), text(F.col("user_id") % 3)),
                     F.lit("host.name"), F.lit("dropped"), F.lit("codex.k"), F.lit("x")).alias("resource"),
        F.create_map(F.lit("k"), text(k % 5), F.lit("codex.k"), F.lit("y")).alias("attributes"),
        F.lit(1).cast("bigint").alias("as_int"), F.col("value").alias("as_double"))
    pts = metrics.points(raw).withColumn("labels", F.map_filter("labels", lambda key, _: key != "codex.k"))
    return metrics.rollup(pts).withColumn("value", F.round("value", 4))


@query("A9_diagnostics_cap", """
  WITH d AS (SELECT l_suppkey AS path, l_orderkey * 10 + l_linenumber AS line, 'msg-' || (l_partkey % 10) AS message FROM lineitem),
  kept AS (SELECT path, line, message FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, message) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY path, message ORDER BY line) AS r FROM d) WHERE r <= 3) WHERE n < 20)
  SELECT path, line, message FROM kept UNION ALL
  SELECT path, NULL, 'additional diagnostics suppressed' FROM d GROUP BY path
    HAVING count(*) > (SELECT count(*) FROM kept k WHERE k.path = d.path)""")
def diagnostics_cap(spark, sf):
    d = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"),
        F.concat(F.lit("msg-"), (F.col("l_partkey") % 10).cast("string")).alias("message"))
    return summary.cap_diagnostics(d)


@query("A10_coverage", f"""
  WITH a AS ({ACTIONS_SQL}), f AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'codex' WHEN 1 THEN 'cursor' ELSE 'pi' END AS source_agent FROM documents)
  SELECT coalesce(x.source_agent, y.source_agent) AS source_agent, coalesce(artifacts_found, 0) AS artifacts_found,
    coalesce(artifacts_parsed, 0) AS artifacts_parsed, coalesce(events, 0) AS events, last_seen
  FROM (SELECT source_agent, count(*) AS artifacts_found FROM f GROUP BY 1) x FULL JOIN (
    SELECT source_agent, count(DISTINCT local_path) AS artifacts_parsed, CAST(count(*) AS BIGINT) AS events,
      max("timestamp") AS last_seen FROM a GROUP BY 1) y ON x.source_agent = y.source_agent""")
def coverage(spark, sf):
    m = F.col("doc_id") % 3
    found = table(spark, sf, "documents").select(
        F.when(m == 0, "codex").when(m == 1, "cursor").otherwise("pi").alias("source_agent"))
    return summary.coverage(found, actions(spark, sf))


@query("U2_distinct_refs", f"""
  SELECT DISTINCT local_path FROM ({ACTIONS_SQL}) WHERE local_path IS NOT NULL""")
def distinct_refs(spark, sf):
    return actions(spark, sf).select("evidence.local_path").where("local_path IS NOT NULL").distinct()


