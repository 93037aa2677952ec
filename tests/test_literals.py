"""The literal index: no predicate loses a match, and commands stay unparsed where nothing can match."""

import random
import re

import pytest
from pyspark.sql import functions as F

from actiontrail.operators import literals as L
from actiontrail.operators import rules as R
from actiontrail.plans.adapters import actions
from actiontrail.schema import conform, evidence
from tests.test_rules import BENIGN, CMD, POSITIVE

PATTERNS = [
    (r"(?i)\A(?:curl|wget)\z", {"curl", "wget"}), (r"\Aa+bc[xy]d*ef\z", {"bcx", "bcy"}), (r"foo.*longer", {"longer"}),
    (r"(?:ab|.*)c", None), (r"[a-z]+", None), (r"(?=.*needle)x?", {"needle"}), (r"(?!needle)abc", {"abc"}), (r"a\x1fbcd", {"bcd"}),
    (r"(?:--flag[= ])?value", {"value"}), (r"(?:x{2}yz){1,3}", {"yz"}), (r"\p{L}abc", None), (r"it's me", {"s me"}), (r"\.env(?:\.local)?", {".env"}),
]


@pytest.mark.parametrize(("pattern", "want"), PATTERNS)
def test_pattern_literals(pattern, want):
    assert L.pattern_literals(pattern) == (want and frozenset(want))


def test_every_match_spells_a_literal():
    rng = random.Random(4)
    parts = ["ab", "c", "(?:de|fgh)", "[xy]", "[^z]", "i*", "(?:jk)+", "l?", ".", "(?:m|)", "(?i:no)", r"\s"]
    for _ in range(400):
        pattern = "".join(rng.choices(parts, k=rng.randrange(1, 6)))
        needed = L.pattern_literals(pattern)
        for _ in range(20):
            text = "".join(rng.choices("abcdefghijklmnoxyNO ", k=rng.randrange(1, 25))) + rng.choice(["abcde", "jkjkfgh", "nodeab"])
            if needed and re.search(pattern, text):
                assert any(x in text.lower() for x in needed), (pattern, text)


def spelt_otherwise(text, rng):
    """The same command to the parser: words in quotes, letters in quotes, capitals of names."""
    if rng.random() < 0.5:
        return re.sub(r"(?<![\w'\"$/.-])([a-z]{3,})(?![\w'\"])", lambda m: f"{m[1][:1]}'{m[1][1:2]}'{m[1][2:]}", text, count=1)
    return re.sub(r"\A([a-z]+)", lambda m: f'"{m[1]}"', text)


def frame(spark, rows):
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "seq bigint, event_type string, v string")
    put = lambda cond: F.when(cond, F.col("v"))
    kind = F.col("event_type")
    return conform(df.withColumns({
        "event_id": F.col("seq").cast("string"), "source_agent": F.lit("codex"), "source_type": F.lit("hook"), "confidence": F.lit("high"),
        "evidence": evidence("hook"), "command": put(kind.startswith("command")), "file_path": put(kind.startswith("file")),
        "url": put(kind == "network.indicator")}))


def found(df):
    return sorted((r.seq, r.rule_pos, r.command_static) for r in df.select("seq", "rule_pos", "command_static").collect())


def ungated(df, rules):
    view = R.rule_view(df.withColumn("_raw", F.struct(*df.columns)))
    return found(R.single_matches(df, rules, view))


def test_no_rule_loses_a_match(spark):
    rng = random.Random(8)
    plain = [(k, v) for _, k, v in POSITIVE] + BENIGN
    rows = plain + [(k, spelt_otherwise(v, rng)) for k, v in plain if k == CMD] + [
        (k, f"true && {v}") for k, v in plain if k == CMD] + [(k, f"bash -c {v!r}") for k, v in plain if k == CMD]
    df = frame(spark, rows).unionByName(conform(frame(spark, [("config.agent", "")]).withColumns({
        "tags": F.array(F.lit("permission_mode_elevated")), "seq": F.lit(10_000).cast("bigint")})))
    rules = R.load_rules()
    got = found(R.single_matches(df, rules, indexed=True))
    assert got == ungated(df, rules) and len({p for _, p, _ in got}) == sum(1 for r in rules if r.expr)


def test_rules_without_literals_and_many_rules(spark):
    """Predicates of which nothing is known are always asked; more rules than one mask has bits."""
    rules = [R.Rule(f"r{i}", "1", "t", "low", expr=f"exists(commands, c -> c.name = 'tool{i}')") for i in range(150)]
    rules += [R.Rule("len", "1", "t", "low", expr="length(command) > 12"), R.Rule("not", "1", "t", "low", expr="NOT exists(commands, c -> c.name = 'tool1')"),
              R.Rule("low", "1", "t", "low", expr="lower(command) rlike 'TOOL' OR tool_name = 'x'")]
    df = frame(spark, [(CMD, f"tool{i} a") for i in range(0, 150, 7)] + [(CMD, "ls"), (CMD, "'to'ol3 with words"), ("file.read", "/x")])
    assert found(R.single_matches(df, rules, indexed=True)) == ungated(df, rules)


def test_unasked_commands_stay_unparsed(spark):
    df = frame(spark, [(CMD, "ls -la"), (CMD, "sudo -l"), (CMD, "echo hi")])
    seen = R.rule_view(df, texts=["exists(commands, c -> c.name = 'sudo')"]).select("commands").collect()
    assert [r.commands is not None for r in seen] == [False, True, False]


def test_chains_from_gated_steps(spark, sf_dir):
    from actiontrail.operators import chains

    rules = [r for r in R.load_rules() if r.steps]
    df = actions(spark, sf_dir)
    key = lambda f: sorted((r.rule_id, *r.cited_event_ids) for r in f.collect())
    plain = [R._chain_rule(r, [R._predicate(s) for s in r.steps]) for r in rules]
    want = key(chains.chain_matches(R.rule_view(df), plain))
    assert want and want == key(chains.chain_matches(R.rule_view(df, texts=R.step_texts(rules)), R.chain_rules(rules)))
