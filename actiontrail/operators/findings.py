"""Findings: rendering of rule matches and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from actiontrail.functions.redact import redact_columns
from actiontrail.functions.scalars import (activity_timestamp, blank_to_null, finding_id, hash_path,
                                           merge_tags)
from actiontrail.schema import SCHEMA_VERSION

# observed column -> event column; masked on output.
OBSERVED = {
    "observed_command": "command", "observed_file_path": "file_path",
    "observed_url": "url", "observed_mcp_server": "mcp_server",
    "observed_mcp_tool": "mcp_tool", "observed_content_preview": "content_preview",
}
_RANK = {"high": 3, "medium": 2, "low": 1}


def weakest_confidence(levels: Column) -> Column:
    """The least certain link of a chain; an unknown level counts as low."""
    rank = lambda c: F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)
    low = F.array_min(F.transform(levels, rank))
    return F.when(low == 3, "high").when(low == 2, "medium").otherwise("low")


def _render(df: DataFrame, detected_at: Column) -> DataFrame:
    """Expects the completing event's columns plus rule_* and cited links."""
    df = redact_columns(df, OBSERVED)
    changed = F.lit(False)
    for out, raw in OBSERVED.items():
        changed = changed | F.coalesce(F.col(out) != F.col(raw), F.lit(False))
    return df.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        finding_id(F.col("rule_id"), F.col("rule_version"), F.col("cited_event_ids")).alias("finding_id"),
        "case_id", activity_timestamp("timestamp").alias("timestamp"),
        detected_at.alias("detected_at"), "rule_id", "rule_version", "severity",
        "source_agent", "source_type", hash_path("project_path").alias("project_path_hash"),
        "session_id", "model", "model_provider", "sub_agent", "title",
        F.col("event_type").alias("observed_event_type"), F.col("actor").alias("observed_actor"),
        *[blank_to_null(F.col(c)).alias(c) for c in OBSERVED],
        F.col("finding_tags").alias("tags"), "evidence_refs", "cited_event_ids",
        changed.alias("redacted"), F.col("finding_confidence").alias("confidence"))


def from_matches(matches: DataFrame, detected_at: Column) -> DataFrame:
    """`matches`: event columns plus rule_id, rule_version, severity, title, rule_tags."""
    return _render(matches.withColumns({
        "finding_tags": merge_tags("tags", "rule_tags"),
        "evidence_refs": F.array("evidence"),
        "cited_event_ids": F.array("event_id"),
        "finding_confidence": F.col("confidence")}), detected_at)


def from_chains(chains: DataFrame, catalog: DataFrame, detected_at: Column) -> DataFrame:
    """Findings of completed chains, which carry their completing events."""
    # The catalogue is bounded by the number of rule files.
    rows = chains.select("*", "final_event.*").drop("final_event").join(F.broadcast(catalog), "rule_id")
    links = F.col("links")
    rows = rows.withColumns({
        "finding_tags": merge_tags("rule_tags", F.flatten(F.transform(
            links, lambda x: F.coalesce(x["tags"], F.array().cast("array<string>"))))),
        "evidence_refs": F.transform(links, lambda x: x["evidence"]),
        "finding_confidence": weakest_confidence(F.transform(links, lambda x: x["confidence"]))})
    return _render(rows, detected_at)


def counts_per_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id", "severity").agg(F.count("*").alias("findings"))
