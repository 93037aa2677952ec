"""The event contract: which rows may reach detection and output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from actiontrail import schema as S
from actiontrail.functions.scalars import any_of, normalize_path, present

_HEX64 = r"\A[0-9a-f]{64}\z"


def _vocab(column: str, values, optional: bool) -> Column:
    known = any_of(F.col(column), values)
    return present(column) & ~known if optional else ~known


def for_agents(rows: DataFrame, agents: Sequence[str] | None) -> DataFrame:
    """Events or artifacts of the named agents; all without names. An unknown name is an error, not an empty result."""
    if agents is None:
        return rows
    unknown = set(agents) - set(S.SOURCE_AGENTS)
    if unknown:
        raise ValueError(f"unknown agents {sorted(unknown)}")
    return rows.where(F.col("source_agent").isin(*agents))


def _filled(column: str) -> Column:
    if column in ("exit_code", "duration_ms", "approval_required"):
        return F.col(column).isNotNull()
    if column == "diff_bytes":
        return F.coalesce(F.col(column) != 0, F.lit(False))
    return present(column)


def _disallowed(column: str) -> Column:
    """A filled action column on an event type that may not carry it."""
    allowed = [t for t, cols in S.ALLOWED_COLUMNS.items() if column in cols]
    return _filled(column) & any_of(F.col("event_type"), S.EVENT_TYPES) & ~any_of(
        F.col("event_type"), allowed)


def violations() -> Column:
    """All broken rules of a row as a sorted-by-check array of reasons."""
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    trimmed = lambda t: F.regexp_replace(t, r"(?U)\A\s+|\s+\z", "")
    checks: list[tuple[str, Column]] = [
        ("schema_version", F.coalesce(F.col("schema_version") != S.SCHEMA_VERSION, F.lit(True))),
        ("event_id", ~present("event_id")),
        ("event_type", _vocab("event_type", S.EVENT_TYPES, optional=False)),
        ("confidence", _vocab("confidence", S.CONFIDENCES, optional=False)),
        ("source_agent", _vocab("source_agent", S.SOURCE_AGENTS, optional=False)),
        ("source_type", _vocab("source_type", S.SOURCE_TYPES, optional=False)),
        ("actor", _vocab("actor", S.ACTORS, optional=True)),
        ("decision", _vocab("decision", S.DECISIONS, optional=True)),
        ("approval_decision", _vocab("approval_decision", S.DECISIONS, optional=True)),
        ("evidence.artifact_type", ~present("evidence.artifact_type")),
        ("tags.empty", F.exists(tags, lambda t: t.isNull() | (trimmed(t) == ""))),
        ("tags.whitespace", F.exists(tags, lambda t: (trimmed(t) != "") & (trimmed(t) != t))),
        ("tags.duplicate", F.size(F.array_distinct(tags)) < F.size(tags)),
        ("evidence.line", F.coalesce(F.col("evidence.line") < 0, F.lit(False))),
        ("evidence.rowid", F.coalesce(F.col("evidence.rowid") < 0, F.lit(False))),
        ("evidence.sha256", present("evidence.sha256") & ~F.col("evidence.sha256").rlike(_HEX64)),
        ("diff_sha256", present("diff_sha256") & ~F.col("diff_sha256").rlike(_HEX64)),
        ("diff_bytes", F.coalesce(F.col("diff_bytes") < 0, F.lit(False))),
        ("duration_ms", F.coalesce(F.col("duration_ms") < 0, F.lit(False))),
    ]
    checks += [(f"column.{c}", _disallowed(c)) for c in S.ACTION_COLUMNS]
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))


def normalized(df: DataFrame) -> DataFrame:
    """Semantic paths use forward slashes; evidence paths stay as they were."""
    return df.withColumns({"project_path": normalize_path("project_path"),
                           "file_path": normalize_path("file_path")})


def check(df: DataFrame) -> DataFrame:
    return normalized(df).withColumn("violations", violations())


def valid(df: DataFrame) -> DataFrame:
    checked = check(df)
    return checked.where(F.size("violations") == 0).drop("violations")


def quarantine(df: DataFrame) -> DataFrame:
    return check(df).where(F.size("violations") > 0)


def capture_profile(df: DataFrame, full: bool) -> DataFrame:
    """The evidence profile drops reasoning rows and model context."""
    if full:
        return df
    return df.where(F.col("event_type") != "message.reasoning").withColumns({
        "model": F.lit(None).cast("string"), "model_provider": F.lit(None).cast("string")})
