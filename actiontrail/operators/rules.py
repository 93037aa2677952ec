"""Rule catalogue: loading, checking, compiling and evaluating.

A rule is a YAML file whose predicate is a Spark SQL boolean expression over
the event columns and the parsed `commands`. All enabled rules are evaluated
in one projection; rows without a match never leave the scan stage.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from actiontrail import schema as S
from actiontrail.functions.commands import command_columns
from actiontrail.operators import literals as L
from actiontrail.operators.chains import ChainRule

BUILTIN_DIR = Path(__file__).resolve().parent.parent / "rules"
_FIELDS = {"id", "version", "title", "description", "severity", "enabled", "enforce",
           "deny_message", "expr", "sequence", "tags"}
_SEQUENCE_FIELDS = {"within", "within_events", "max_matches", "steps"}
_ID = re.compile(r"\A[a-z0-9_]+(?:[.-][a-z0-9_]+)*\Z")
_DURATION = re.compile(r"([0-9]+(?:\.[0-9]+)?)(ns|us|µs|ms|s|m|h)")
_UNIT = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Rule:
    id: str
    version: str
    title: str
    severity: str
    description: str = ""
    enabled: bool = True
    enforce: bool = False
    deny_message: str = ""
    expr: str | None = None
    steps: tuple[str, ...] = ()
    within: float | None = None
    within_events: int | None = None
    max_matches: int = 1
    tags: tuple[str, ...] = ()
    path: str = ""

    @property
    def uses_commands(self) -> bool:
        return any("commands" in e for e in ((self.expr or ""), *self.steps))


def duration_seconds(text: str) -> float:
    if not text or _DURATION.sub("", text):
        raise RuleError(f"invalid duration {text!r}")
    total = sum(float(n) * _UNIT[u] for n, u in _DURATION.findall(text))
    if total <= 0:
        raise RuleError(f"duration {text!r} must be positive")
    return total


def parse_rule(doc: object, path: str = "") -> Rule:
    if not isinstance(doc, dict):
        raise RuleError(f"{path}: a rule file holds one mapping")
    unknown = set(doc) - _FIELDS
    if unknown:
        raise RuleError(f"{path}: unknown fields {sorted(unknown)}")
    for name in ("id", "version", "title", "severity"):
        if not isinstance(doc.get(name), str) or not doc[name].strip():
            raise RuleError(f"{path}: {name} is required")
    if not _ID.match(doc["id"]):
        raise RuleError(f"{path}: invalid id {doc['id']!r}")
    if doc["severity"] not in S.SEVERITIES:
        raise RuleError(f"{path}: invalid severity {doc['severity']!r}")
    seq = doc.get("sequence")
    if bool(doc.get("expr")) == bool(seq):
        raise RuleError(f"{path}: exactly one of expr and sequence is required")
    rule = Rule(id=doc["id"], version=doc["version"], title=doc["title"], severity=doc["severity"],
                description=doc.get("description") or "", enabled=doc.get("enabled", True) is not False,
                enforce=doc.get("enforce") is True, deny_message=doc.get("deny_message") or "",
                expr=doc.get("expr"), tags=tuple(doc.get("tags") or ()), path=path)
    if not seq:
        return rule
    extra = set(seq) - _SEQUENCE_FIELDS
    if extra:
        raise RuleError(f"{path}: unknown sequence fields {sorted(extra)}")
    steps = tuple((s.get("expr") or "").strip() for s in seq.get("steps") or ())
    if any(not s for s in steps):
        raise RuleError(f"{path}: empty step")
    out = replace(rule, steps=steps, within_events=seq.get("within_events") or None,
                  within=duration_seconds(seq["within"]) if seq.get("within") else None,
                  max_matches=seq.get("max_matches") or 1)
    try:
        _chain_rule(out, [F.lit] * len(steps), probe=True)
    except ValueError as err:
        raise RuleError(f"{path}: {err}") from None
    return out


def _chain_rule(rule: Rule, steps: Sequence[object], probe: bool = False) -> ChainRule:
    return ChainRule(rule.id, tuple(steps), rule.within_events, rule.within, rule.max_matches)


def _read(folder: Path) -> tuple[list[Rule], dict]:
    import yaml

    rules, fragments = [], {}
    for path in sorted(p for p in folder.rglob("*") if p.suffix.lower() in (".yaml", ".yml")):
        if path.stem.endswith("_tests"):
            continue
        try:
            docs = list(yaml.safe_load_all(path.read_text()))
        except yaml.YAMLError as err:
            raise RuleError(f"{path}: {err}") from None
        if len(docs) != 1:
            raise RuleError(f"{path}: one rule per file")
        if path.stem == "fragments":
            fragments = docs[0]
            continue
        rules.append(parse_rule(docs[0], str(path.relative_to(folder))))
    return rules, fragments


def _expand(text: str, fragments: dict, rules: dict[str, Rule]) -> str:
    """Replace `{{name}}`, `{{macro:name}}` and `{{rule:id}}` until none is left."""
    values, macros = fragments.get("values", {}), fragments.get("macros", {})

    def put(match: re.Match) -> str:
        key = match.group(1)
        if key in values:
            return values[key]
        head, _, arg = key.partition(":")
        if head == "rule" and arg in rules:
            return f"({rules[arg].expr})"
        if head in macros and arg in values:
            return macros[head].replace("%p%", values[arg])
        raise RuleError(f"unknown fragment {key!r}")

    for _ in range(8):
        text, n = re.subn(r"\{\{([a-z_:.]+)\}\}", put, text)
        if not n:
            return text
    raise RuleError("fragments refer to each other in a circle")


def load_rules(folder: str | Path = BUILTIN_DIR, fragments: dict | None = None) -> list[Rule]:
    """Rules of one folder in path order, fragments expanded, ids unique."""
    folder = Path(folder)
    rules, own = _read(folder)
    if not rules:
        raise RuleError(f"{folder}: no rule files")
    by_id: dict[str, Rule] = {}
    for r in rules:
        if r.id in by_id:
            raise RuleError(f"duplicate rule id {r.id!r}: {by_id[r.id].path} and {r.path}")
        by_id[r.id] = r
    frag = own or fragments or {}
    return [replace(r, expr=r.expr and _expand(r.expr, frag, by_id),
                    steps=tuple(_expand(s, frag, by_id) for s in r.steps)) for r in rules]


def overlay(builtin: Sequence[Rule], operator: Sequence[Rule]) -> list[Rule]:
    """An operator rule with a known id takes that place; new ids append."""
    mine = {r.id: r for r in operator}
    known = {r.id for r in builtin}
    return [mine.get(r.id, r) for r in builtin] + [r for r in operator if r.id not in known]


def overlay_frames(builtin: DataFrame, operator: DataFrame) -> DataFrame:
    """The same precedence over catalogue tables (rule_id, rule_pos, …)."""
    kept = builtin.join(operator.select("rule_id"), "rule_id", "left_anti").withColumn("layer", F.lit("builtin"))
    pos = builtin.select("rule_id", F.col("rule_pos").alias("_pos"))
    top = builtin.agg(F.coalesce(F.max("rule_pos") + 1, F.lit(0)).alias("_top"))
    ours = (operator.join(pos, "rule_id", "left").crossJoin(F.broadcast(top))  # one row
            .withColumn("rule_pos", F.coalesce("_pos", F.col("_top") + F.col("rule_pos")))
            .drop("_pos", "_top").withColumn("layer", F.lit("operator")))
    return kept.unionByName(ours)


CATALOG_SCHEMA = T.StructType([
    T.StructField("rule_pos", T.IntegerType()), T.StructField("rule_id", T.StringType()),
    T.StructField("rule_version", T.StringType()), T.StructField("severity", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("rule_tags", T.ArrayType(T.StringType())),
    T.StructField("enforce", T.BooleanType()), T.StructField("uses_commands", T.BooleanType())])


def catalog_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [(i, r.id, r.version, r.severity, r.title, sorted(r.tags), r.enforce, r.uses_commands)
            for i, r in enumerate(rules) if r.enabled]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


# --- evaluation --------------------------------------------------------------


def command_gate() -> Column:
    """Requested commands, or completed ones where telemetry shows no request."""
    kind = F.coalesce(F.col("event_type"), F.lit(""))
    return (kind == "command.exec") | ((F.coalesce("source_type", F.lit("")) == "otel")
                                       & (kind == "command.result"))


def rule_view(events: DataFrame, with_commands: bool = True, texts: Sequence[str] | None = None) -> DataFrame:
    """Events as predicates see them: absent text is empty, commands parsed.

    `texts`, the predicates that will be asked, keeps commands unparsed where none of them can hold.
    """
    view = _plain_view(events).withColumn(L.SEARCH_TEXT, L.search_text())
    if not with_commands:
        return view
    wanted = F.col("is_command")
    if texts is not None:
        some = F.lit(False)
        for text in texts:
            some = some | L.gate(L.command_literals(events.sparkSession, text))
        wanted = wanted & some
    return command_columns(view, "command", wanted)


def _plain_view(events: DataFrame) -> DataFrame:
    view = events.withColumn("is_command", command_gate())
    texts = [f.name for f in view.schema.fields
             if isinstance(f.dataType, T.StringType) and f.name in S.EVENT_COLUMNS]
    view = view.withColumns({
        **{c: F.coalesce(F.col(c), F.lit("")) for c in texts},
        "diff_bytes": F.coalesce("diff_bytes", F.lit(0).cast("bigint")),
        "tags": F.coalesce("tags", F.array().cast("array<string>"))})
    return view


def _gated_view(events: DataFrame, with_commands: bool, asked: Sequence[str]) -> tuple[DataFrame, list[Column | None]]:
    """The view and, for each predicate asked, the test of its literals (None: none are known)."""
    view, tests = L.with_masks(_plain_view(events), asked)
    # Without literals a predicate may hold for any event, or for those that can be told without commands.
    wanted = F.lit(False)
    for test, text in zip(tests, asked):
        wanted = wanted | (test if test is not None else F.lit(True) if "command" in text else _predicate(text))
    return (command_columns(view, "command", F.col("is_command") & wanted) if with_commands else view), tests


def check_rules(spark: SparkSession, rules: Iterable[Rule]) -> None:
    """Analyse every predicate against an empty typed frame.

    Unknown columns and non-boolean predicates fail here, not per event.
    """
    empty = rule_view(spark.createDataFrame([], S.EVENT_SCHEMA))
    for rule in rules:
        for text in ((rule.expr,) if rule.expr else rule.steps):
            try:
                kind = empty.select(F.expr(text).alias("p")).schema["p"].dataType
            except Exception as err:
                raise RuleError(f"{rule.id}: {str(err).splitlines()[0]}") from None
            if not isinstance(kind, T.BooleanType):
                raise RuleError(f"{rule.id}: predicate is {kind.simpleString()}, not boolean")


def _predicate(text: str) -> Column:
    return F.coalesce(F.expr(text), F.lit(False))


def needs_commands(rules: Iterable[Rule]) -> bool:
    return any(r.uses_commands for r in rules if r.enabled)


def single_matches(events: DataFrame, rules: Sequence[Rule], view: DataFrame | None = None, indexed: bool = False) -> DataFrame:
    """`(event columns, rule_pos, command_static)` for every matching rule.

    Identical predicate texts are compiled once; the event columns are the
    raw ones, so findings render what the sensor saw. `indexed` asks the literal index first, which pays only where
    most events hold no rule's literals.
    """
    active = [(i, r) for i, r in enumerate(rules) if r.enabled and r.expr]
    by_text: dict[str, list[int]] = {}
    for i, r in active:
        by_text.setdefault(r.expr, []).append(i)
    tests: list[Column | None] = [None] * len(by_text)
    if view is None:
        raw, commands = events.withColumn("_raw", F.struct(*events.columns)), needs_commands([r for _, r in active])
        if indexed:
            view, tests = _gated_view(raw, commands, list(by_text))
        else:
            view = rule_view(raw, commands)
    gated = [p if t is None else F.when(t, p) for t, p in zip(tests, map(_predicate, by_text))]
    hits = F.flatten(F.array_compact(F.array(*[
        F.when(hit, F.array(*[F.lit(i) for i in places])) for hit, places in zip(gated, by_text.values())])))
    static = (F.col("command_static") if "command_static" in view.columns else F.lit(True))
    found = view.select("_raw", (~F.col("is_command") | static).alias("command_static"),
                        hits.alias("_hits"))
    # A plain explode would let the optimizer infer a filter from the whole
    # predicate array and inline the command parser into it many times over;
    # the outer form is evaluated once and the empty rows go right after it.
    return (found.select("_raw", "command_static", F.explode_outer("_hits").alias("rule_pos"))
            .where(F.col("rule_pos").isNotNull()).select("_raw.*", "command_static", "rule_pos"))


def matches(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Single-event matches with catalogue columns joined on."""
    spark = events.sparkSession
    # The catalogue is bounded by the number of rule files.
    return single_matches(events, rules).join(
        F.broadcast(catalog_frame(spark, rules)), "rule_pos").withColumn(
        "eligible", F.col("enforce") & (~F.col("uses_commands") | F.col("command_static")))


def chain_rules(rules: Sequence[Rule]) -> list[ChainRule]:
    """Chains whose steps are asked of a `rule_view`."""
    spark = SparkSession.getActiveSession()

    def step(text: str) -> Column:
        needed = L.needed_literals(spark, text)
        return _predicate(text) if needed is None else F.when(L.gate(needed), _predicate(text))

    return [_chain_rule(r, [step(s) for s in r.steps]) for r in rules if r.enabled and r.steps]


def step_texts(rules: Sequence[Rule]) -> list[str]:
    """The predicates that chains ask, for `rule_view`."""
    return [s for r in rules if r.enabled and r.steps for s in r.steps]


# --- companion expectations --------------------------------------------------

def expectation_report(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """`expected`: rule_id, case_name, expect (match | no_match);
    `actual`: rule_id, case_name of the matches. One row per expectation."""
    hit = actual.select("rule_id", "case_name").distinct().withColumn("_hit", F.lit(True))
    got = F.when(F.col("_hit"), "match").otherwise("no_match")
    return (expected.join(hit, ["rule_id", "case_name"], "left")
            .select("rule_id", "case_name", "expect", got.alias("got"))
            .withColumn("passed", F.col("expect") == F.col("got")))
