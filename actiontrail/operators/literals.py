"""Literals a predicate cannot do without, and a bit per predicate that says whether an event's text has one of them.

Spark parses a predicate; its tree says which strings have to occur: an AND needs what any of its sides needs, an OR one of what all its sides
need, an equality or IN its values, a regular expression the strings every match spells. A predicate of which nothing
is known, or only strings of one letter, is always evaluated. Texts are compared in lower case, without the characters that quoting takes
out of a command, so that a name found by the command parser is also found here.
"""

from __future__ import annotations

import itertools
import json
import re
import warnings
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SEARCH_TEXT = "_search_text"
# Columns and fields whose values are pieces of the searched text.
TEXT_COLUMNS = ("command", "file_path", "url")
TEXT_FIELDS = ("name", "args", "line", "target", "executable", "source", "wrapper_args", "value", "operands")
# Quoting and separators, which a value may have lost.
_DROPPED = "'\"\\\n"
_MOST = 64
_SHORTEST = 2
MASK_BITS = 62

Needed = frozenset[str]


def _usable(letter: str) -> bool:
    return letter.isascii() and letter.isprintable() and letter not in _DROPPED


def _better(found: list[Needed | None]) -> Needed | None:
    """Of several sets that are all required, the one that is hardest to meet by chance."""
    good = [s for s in found if s and len(s) <= _MOST and min(map(len, s)) >= _SHORTEST]
    return max(good, key=lambda s: (min(map(len, s)), -len(s), sorted(s)), default=None)


def _either(found: list[Needed | None]) -> Needed | None:
    if not found or any(s is None for s in found):
        return None
    return _better([frozenset(itertools.chain(*found))])


def text_literals(value: str) -> Needed | None:
    """What a text that holds `value` has to hold: its longest usable part."""
    parts = ["".join(g) for ok, g in itertools.groupby(value.lower(), _usable) if ok]
    return _better([frozenset([p]) for p in parts])


def pattern_literals(pattern: str) -> Needed | None:
    """Strings of which every match of a regular expression spells one; None where none is certain."""
    from re import _constants as C, _parser

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = _parser.parse(pattern.replace(r"\z", r"\Z"))
    except (re.error, OverflowError, RecursionError):
        return None

    def spelt(items) -> frozenset[str] | None:
        """All strings a sequence can spell, if they are few and certain."""
        out = {""}
        for op, arg in items:
            if op is C.LITERAL:
                more = {chr(arg).lower()}
            elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
                more = {chr(a).lower() for _, a in arg}
            elif op is C.SUBPATTERN:
                more = spelt(arg[3])
            elif op is C.BRANCH:
                each = [spelt(b) for b in arg[1]]
                more = None if None in each else set().union(*each)
            elif op is C.AT:
                more = {""}
            else:
                return None
            if more is None or len(out) * len(more) > _MOST or not all(map(_usable, itertools.chain(*more))):
                return None
            out = {a + b for a in out for b in more}
        return frozenset(out)

    def required(items) -> Needed | None:
        found: list[Needed | None] = []
        run: frozenset[str] = frozenset([""])
        for item in [*items, None]:
            whole = spelt([item]) if item is not None else None
            if whole is not None and len(run) * len(whole) <= _MOST:
                run = frozenset(a + b for a in run for b in whole)
                continue
            found.append(run)
            run = frozenset([""]) if whole is None else whole
            if item is None or whole is not None:
                continue
            op, arg = item
            if op is C.SUBPATTERN:
                found.append(required(arg[3]))
            elif op is C.BRANCH:
                found.append(_either([required(b) for b in arg[1]]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
                found.append(required(arg[2]))
            elif op is C.ATOMIC_GROUP:
                found.append(required(arg))
            elif op is C.ASSERT and arg[0] > 0:
                found.append(required(arg[1]))
        return _better(found)

    return required(list(tree))


@lru_cache(maxsize=1024)
def _tree(text: str, application: str) -> tuple:
    """Spark's own parse of a predicate: (class, facts, children), nested."""
    spark = SparkSession.getActiveSession()
    nodes = iter(json.loads(spark._jsparkSession.sessionState().sqlParser().parseExpression(text).toJSON()))

    def node() -> tuple:
        facts = next(nodes)
        return facts["class"].rsplit(".", 1)[-1], facts, [node() for _ in range(facts["num-children"])]

    return node()


def _names(facts: dict) -> list[str]:
    return [n.strip().lower() for n in str(facts.get("nameParts", "")).strip("[]").split(",")]


def _is_text(node: tuple) -> bool:
    kind, facts, children = node
    if kind == "UnresolvedFunction":
        return _names(facts) == ["lower"] and _is_text(children[0])
    if kind not in ("UnresolvedAttribute", "UnresolvedNamedLambdaVariable"):
        return False
    names = _names(facts)
    return names[0] in TEXT_COLUMNS if len(names) == 1 else len(names) == 2 and names[1] in TEXT_FIELDS


def _literal(node: tuple) -> str | None:
    kind, facts, _ = node
    return facts["value"] if kind == "Literal" and facts.get("dataType") == "string" else None


def _needed(node: tuple) -> Needed | None:
    kind, facts, children = node
    if kind == "And":
        return _better([_needed(c) for c in children])
    if kind == "Or":
        return _either([_needed(c) for c in children])
    if kind == "LambdaFunction":
        return _needed(children[0])
    if kind in ("EqualTo", "In") and _is_text(children[0]):
        values = [_literal(c) for c in children[1:]]
        return None if None in values else _either([text_literals(v) for v in values])
    if kind == "RLike" and _is_text(children[0]):
        pattern = _literal(children[1])
        return None if pattern is None else pattern_literals(pattern)
    if kind == "UnresolvedFunction":
        name = _names(facts)[-1]
        if name == "exists" and len(children) == 2:
            return _needed(children[1])
        if name in ("contains", "startswith", "endswith", "array_contains") and _is_text(children[0]):
            value = _literal(children[1])
            return None if value is None else text_literals(value)
    return None


def needed_literals(spark: SparkSession, text: str) -> Needed | None:
    """Literals of which an event's text has at least one wherever the predicate `text` holds; None: not known."""
    return _needed(_tree(text, spark.sparkContext.applicationId))


def _reads_commands(node: tuple) -> bool:
    kind, facts, children = node
    return (kind == "UnresolvedAttribute" and _names(facts)[0].startswith("command")) or any(map(_reads_commands, children))


def _for_commands(node: tuple) -> Needed | None:
    """Like `_needed`, of the parts of a predicate that look at commands; empty where none does."""
    kind, _, children = node
    if not _reads_commands(node):
        return frozenset()
    if kind == "Or":
        found = [n for n in map(_for_commands, children) if n is None or n]
        return _either(found)
    return _needed(node)


def command_literals(spark: SparkSession, text: str) -> Needed | None:
    """Literals of which an event's text has one wherever `text` depends on its parsed commands; empty: it never does."""
    return _for_commands(_tree(text, spark.sparkContext.applicationId))


def search_text(columns: Sequence[str] = TEXT_COLUMNS) -> Column:
    joined = F.lower(F.concat_ws("\x1d", *columns))
    return F.translate(joined, "\x1e\x1f" + _DROPPED, "  ")


def gate(needed: Needed | None) -> Column:
    """Whether the search text has one of the literals."""
    out = F.lit(needed is None)
    for k, literal in enumerate(sorted(needed or ())):
        hit = F.col(SEARCH_TEXT).contains(literal)
        out = hit if k == 0 else out | hit
    return out


def with_masks(df: DataFrame, texts: Sequence[str]) -> tuple[DataFrame, list[Column | None]]:
    """Adds one bit for each predicate that has literals; (frame, the bit's test for each predicate, None: always evaluated)."""
    needs = [needed_literals(df.sparkSession, t) for t in texts]
    known = [i for i, n in enumerate(needs) if n is not None]
    tests: list[Column | None] = [None] * len(texts)
    masks = {}
    for at in range(0, len(known), MASK_BITS):
        name, bits = f"_literals{at // MASK_BITS}", F.lit(0).cast("bigint")
        for k, i in enumerate(known[at:at + MASK_BITS]):
            bits = bits + F.when(gate(needs[i]), F.lit(1 << k).cast("bigint")).otherwise(0)
            tests[i] = F.col(name).bitwiseAND(F.lit(1 << k).cast("bigint")) != 0
        masks[name] = bits
    return (df.withColumn(SEARCH_TEXT, search_text()).withColumns(masks) if masks else df), tests
