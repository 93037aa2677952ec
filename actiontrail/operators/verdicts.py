"""Policy verdicts: what a blocking sensor would have answered per action."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from actiontrail.functions.scalars import decision_id, finding_id
from actiontrail.schema import SCHEMA_VERSION


CONTEXT = ("case_id", "source_agent", "source_type", "session_id", "model", "model_provider", "sub_agent", "tool_name",
           "tool_call_id")


def chain_actions(chains: DataFrame, catalog: DataFrame) -> DataFrame:
    """Chains as matches of their completing events. A chain may deny where its rule enforces: the steps before the
    last have happened already, and the last is the action that is asked about."""
    rows = chains.join(F.broadcast(catalog), "rule_id")  # bounded by the number of rule files
    have = set(chains.schema["final_event"].dataType.fieldNames())
    context = [(F.col(f"final_event.{c}") if c in have else F.lit(None).cast("string")).alias(c) for c in CONTEXT]
    return rows.select(F.col("final_event_id").alias("event_id"), "rule_id", "rule_version", "rule_pos",
                       finding_id(F.col("rule_id"), F.col("rule_version"), F.col("cited_event_ids")).alias("finding_id"),
                       F.col("enforce").alias("eligible"), *context)


def verdicts(matches: DataFrame, run_id: str, enforce: bool, tainted: DataFrame | None = None) -> DataFrame:
    """`matches`: event_id, rule_id, rule_version, rule_pos, finding_id, eligible and the CONTEXT columns.

    One row per action, however many copies of it arrived. The first eligible rule in catalogue order denies; a
    run whose record delivery failed for the action never denies. Matches per
    action are bounded by the catalogue, so the lists are small.
    """
    hits = matches.groupBy("event_id").agg(
        F.array_sort(F.collect_set(F.struct("rule_pos", "rule_id"))).alias("_rules"),
        F.array_sort(F.collect_set("finding_id")).alias("finding_ids"),
        F.min(F.when(F.col("eligible"), F.struct("rule_pos", "rule_id", "rule_version"))).alias("_deny"),
        F.min(F.struct(*CONTEXT)).alias("_context"))
    rows = hits.select("*", "_context.*").drop("_context")
    if tainted is not None:
        rows = rows.join(tainted.select("event_id", F.lit(True).alias("_tainted")), "event_id", "left")
    else:
        rows = rows.withColumn("_tainted", F.lit(False))
    failed = F.coalesce(F.col("_tainted"), F.lit(False))
    denied = F.lit(enforce) & ~failed & F.col("_deny").isNotNull()
    reason = (F.when(F.lit(not enforce), "monitor_mode").when(failed, "fail_open")
              .when(denied, "enforce_rule_match").otherwise("no_enforce_eligible_match"))
    return rows.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        decision_id(F.lit(run_id), F.array("event_id")).alias("decision_id"), "case_id",
        F.when(denied, "deny").otherwise("no_override").alias("decision"),
        F.lit("enforce" if enforce else "monitor").alias("mode"), reason.alias("reason"),
        "source_agent", "source_type", "session_id", "model", "model_provider", "sub_agent",
        "tool_name", "tool_call_id", F.array("event_id").alias("action_event_ids"), "finding_ids",
        F.transform("_rules", lambda r: r["rule_id"]).alias("rule_ids"),
        F.when(denied, F.col("_deny.rule_id")).alias("deny_rule_id"),
        F.when(denied, F.col("_deny.rule_version")).alias("deny_rule_version"))


def inconsistencies(decisions: DataFrame) -> DataFrame:
    """Decision rows that contradict themselves, with the reasons."""
    deny = F.col("decision") == "deny"
    none = lambda c: F.coalesce(F.size(c) == 0, F.lit(True))
    repeated = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    checks = {
        "schema_version": F.col("schema_version") != SCHEMA_VERSION,
        "decision_id": ~F.col("decision_id").rlike(r"\Aenf-[0-9a-f]{24}\z"),
        "decision": ~F.col("decision").isin("deny", "no_override"),
        "mode": ~F.col("mode").isin("monitor", "enforce"),
        "source_type": F.col("source_type") != "hook",
        "action_event_ids": none("action_event_ids") | repeated("action_event_ids"),
        "rule_ids": none("rule_ids") | repeated("rule_ids"),
        "finding_ids": F.coalesce(repeated("finding_ids"), F.lit(False)),
        "monitor": (F.col("mode") == "monitor") & (deny | (F.col("reason") != "monitor_mode")),
        "deny": deny & ((F.col("reason") != "enforce_rule_match") | F.col("deny_rule_id").isNull()
                        | F.col("deny_rule_version").isNull()
                        | ~F.array_contains("rule_ids", F.col("deny_rule_id"))),
        "no_override": (F.col("mode") == "enforce") & ~deny & ~F.col("reason").isin(
            "no_enforce_eligible_match", "fail_open"),
        "deny_rule": ~deny & (F.col("deny_rule_id").isNotNull() | F.col("deny_rule_version").isNotNull()),
    }
    problems = F.array_compact(F.array(*[
        F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()]))
    return decisions.withColumn("problems", problems).where(F.size("problems") > 0)
