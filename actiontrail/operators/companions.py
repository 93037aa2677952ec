"""Companion cases of rules: small event lists with the answer a rule has to give.

A file named `*_tests.yaml` holds `rule_id` and `cases`; a case has `name`, `expect` (match or no_match), optionally
`expect_enforcement`, and `events`, whose missing fields are filled. All cases of a catalogue are evaluated in one
pass: a case's name goes into its events' ids and correlation fields, so chains cannot cross cases.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from actiontrail import schema as S
from actiontrail.operators import chains
from actiontrail.operators.rules import Rule, RuleError, chain_rules, expectation_report, matches, rule_view

MARK = "\x1d"  # between a case's key and what it stands before


@dataclass(frozen=True)
class Case:
    rule_id: str
    name: str
    expect: str
    enforcement: bool | None
    events: tuple[dict, ...]

    @property
    def key(self) -> str:
        return f"{self.rule_id}/{self.name}"


def _case(rule_id: str, number: int, doc: object, path: str) -> Case:
    if not isinstance(doc, dict) or not doc.get("events"):
        raise RuleError(f"{path}: case {number} has no events")
    name = str(doc.get("name") or "").strip() or f"#{number}"
    expect, enforcement = str(doc.get("expect") or "").strip(), doc.get("expect_enforcement")
    if expect not in ("match", "no_match"):
        raise RuleError(f"{path}: case {name}: expect is match or no_match")
    if enforcement is not None and (expect != "match" or not isinstance(enforcement, bool)):
        raise RuleError(f"{path}: case {name}: expect_enforcement is a yes or no beside expect: match")
    return Case(rule_id, name, expect, enforcement, tuple(doc["events"]))


def load_cases(folder: str | Path) -> list[Case]:
    import yaml

    out: list[Case] = []
    for path in sorted(p for p in Path(folder).rglob("*_tests.*") if p.suffix.lower() in (".yaml", ".yml")):
        doc = yaml.safe_load(path.read_text())
        if not isinstance(doc, dict) or not isinstance(doc.get("rule_id"), str) or not doc.get("cases"):
            raise RuleError(f"{path}: a file of cases holds rule_id and cases")
        out += [_case(doc["rule_id"], i + 1, c, str(path)) for i, c in enumerate(doc["cases"])]
    repeated = {c.key for c in out if sum(d.key == c.key for d in out) > 1}
    if repeated:
        raise RuleError(f"cases with the same name: {sorted(repeated)}")
    return out


def _filled(case: Case, at: int, event: dict) -> dict:
    out = {k: v for k, v in event.items() if v not in ("", None)}
    out = {"schema_version": S.SCHEMA_VERSION, "source_agent": "unknown", "source_type": "artifact", "confidence": "high"} | out
    unknown = set(out) - set(S.EVENT_COLUMNS)
    if unknown:
        raise RuleError(f"case {case.key}: unknown event fields {sorted(unknown)}")
    evidence = {"artifact_type": "rule_fixture"} | (event.get("evidence") or {})
    if out["source_type"] == "artifact":
        evidence["local_path"] = f"{case.key}{MARK}{evidence.get('local_path') or 'rule-fixture'}"
    elif out.get("session_id"):
        out["session_id"] = f"{case.key}{MARK}{out['session_id']}"
    return out | {"evidence": evidence, "event_id": f"{case.key}{MARK}{at}{MARK}{event.get('event_id') or ''}"}


def case_events(spark: SparkSession, cases: Sequence[Case]) -> DataFrame:
    """The events of all cases, filled and kept apart by their case."""
    kinds = {f.name: f.dataType for f in S.EVENT_SCHEMA.fields}
    parts = [f.name for f in kinds["evidence"].fields]
    rows = []
    for case in cases:
        for at, event in enumerate(case.events):
            full = _filled(case, at, event)
            evidence = tuple(full["evidence"].get(n) for n in parts)
            rows.append((*(evidence if n == "evidence" else full.get(n) for n in S.EVENT_COLUMNS if n != S.SEQ), at))
    fields = [f for f in S.EVENT_SCHEMA.fields if f.name != S.SEQ]
    return spark.createDataFrame(rows, T.StructType([*fields, T.StructField(S.SEQ, T.LongType())]))


def case_report(spark: SparkSession, rules: Sequence[Rule], cases: Sequence[Case]) -> DataFrame:
    """rule_id, case_name, expect, got, passed: an expected enforcement that does not come about fails a case too."""
    known = {r.id: r for r in rules}
    unknown = {c.rule_id for c in cases} - set(known)
    if unknown:
        raise RuleError(f"cases for unknown rules {sorted(unknown)}")
    wanted = [known[i] for i in sorted({c.rule_id for c in cases})]
    events = case_events(spark, cases)
    case_of = lambda c: F.substring_index(c, MARK, 1)
    hits = matches(events, wanted).select("rule_id", case_of(F.col("event_id")).alias("_case"), "eligible")
    linked = [r for r in wanted if r.steps and r.enabled]
    if linked:
        found = chains.chain_matches(rule_view(events), chain_rules(linked))
        enforce = F.col("rule_id").isin([r.id for r in linked if r.enforce])
        hits = hits.unionByName(found.select("rule_id", case_of(F.col("final_event_id")).alias("_case"), enforce.alias("eligible")))
    got = hits.groupBy("rule_id", "_case").agg(F.max("eligible").alias("enforced")).where(
        F.col("_case").startswith(F.concat("rule_id", F.lit("/"))))
    got = got.withColumn("case_name", F.substring(F.col("_case"), F.length("rule_id") + 2, F.length("_case")))
    asked = spark.createDataFrame([(c.rule_id, c.name, c.expect, c.enforcement) for c in cases],
                                  "rule_id string, case_name string, expect string, enforcement boolean")
    report = expectation_report(asked, got)
    sides = asked.select("rule_id", "case_name", "enforcement").join(got.select("rule_id", "case_name", "enforced"), ["rule_id", "case_name"], "left")
    same = F.col("enforcement").isNull() | (F.col("enforcement") == F.coalesce("enforced", F.lit(False)))
    return (report.join(sides, ["rule_id", "case_name"]).withColumn("passed", F.col("passed") & same)
            .select("rule_id", "case_name", "expect", "got", "passed"))
