"""Streaming and record-file queries: each runs to the end of its input once.

Outputs go to a fresh folder under the shared checkpoint folder, and the
returned frame reads them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from actiontrail.operators import rules as R
from actiontrail.operators.chains import ChainRule
from actiontrail.plans.adapters import ACTIONS_SQL, actions, table
from actiontrail.plans.detect_queries import _MATCH_SQL, _NUMBERED, _THREE
from actiontrail.plans import scalar_queries  # noqa: F401 - declares the oracle reused below
from actiontrail.plans.registry import ORACLES, query
from actiontrail.session import checkpoint_dir
from actiontrail.sources.records import envelope, read_events, write_records
from actiontrail.streaming import jobs
from actiontrail.streaming.sinks import CommittedSink

WAIT_SECONDS = 900


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/actiontrail-{uuid.uuid4().hex}"


def _stream(spark, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema if name != "events" else spark.read.parquet(f"{sf}/{name}.parquet").schema
    # A pattern, as a stream reads what it finds below a path: a file here, a folder of files elsewhere.
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


class _Streamed:
    """Lets the table adapter run on a stream of the same table."""

    def __init__(self, spark):
        self.read = self
        self._spark = spark

    def parquet(self, path: str) -> DataFrame:
        folder, _, file = path.rpartition("/")
        return _stream(self._spark, folder, file.removesuffix(".parquet"))


def _run(spark, df: DataFrame, mode: str = "append") -> DataFrame:
    out = _folder(spark)
    sink = CommittedSink(f"{out}/out")
    q = jobs.start(df, f"{out}/checkpoint", sink.write, mode=mode)
    if not q.awaitTermination(WAIT_SECONDS):
        q.stop()
        raise TimeoutError("stream did not reach the end of its input")
    return sink.read(spark, df.schema)


@query("K1_S4_record_stream", f"SELECT event_id, event_type, command, file_path FROM ({ACTIONS_SQL})")
def record_stream(spark, sf):
    out = _folder(spark)
    write_records(envelope(actions(spark, sf).drop("seq"), "event", "run-1"), f"{out}/records")
    return read_events(spark, f"{out}/records").select("event_id", "event_type", "command", "file_path")


@query("T1_T5_stream_detect", _MATCH_SQL + """
  SELECT rule_id, count(*) AS findings FROM hits GROUP BY rule_id""")
def stream_detect(spark, sf):
    live = actions(_Streamed(spark), sf).withColumn("clock", F.to_timestamp("timestamp"))
    rules = R.load_rules()
    once = jobs.once_per_id(live, "clock", "1 day").drop("clock")
    found = _run(spark, jobs.detect(once, rules).select("finding_id", "rule_id"))
    return found.groupBy("rule_id").agg(F.count_distinct("finding_id").alias("findings"))


@query("T2_T3_stream_chains", _NUMBERED + _THREE + """
  SELECT 'three' AS rule_id, id1 || ',' || id2 || ',' || id AS chain FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS rn FROM seconds) WHERE rn <= 2""")
def stream_chains(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS)
    none = F.lit(None).cast("string")
    live = actions(_Streamed(spark), sf).withColumns({"source_type": F.lit("hook"), "source_agent": F.lit("codex"),
                                                      "project_path": none})
    kinds = ("config.agent", "file.read", "command.exec")
    rule = ChainRule("three", tuple(F.col("event_type") == k for k in kinds), within_events=20, max_matches=2)
    found = _run(spark, jobs.stateful_chains(live, [rule], "v1"))
    return found.select("rule_id", F.array_join("cited_event_ids", ",").alias("chain"))


@query("T6_stream_indicators", f"SELECT type, value, count FROM ({ORACLES['A1_indicators_actions']})")
def stream_indicators(spark, sf):
    """Cumulative counts; the newest emission per value is the total."""
    live = actions(_Streamed(spark), sf)
    return _run(spark, jobs.indicator_totals(live), "update").groupBy("type", "value").agg(F.max("count").alias("count"))


@query("T8_stream_metrics", """
  SELECT 'tool_calls' AS name, '{"kind":"' || event_type || '"}' AS labels, CAST(count(*) AS DOUBLE) AS value
  FROM events GROUP BY event_type""")
def stream_metrics(spark, sf):
    raw = _stream(spark, sf, "events").select(
        F.lit("tool.calls").alias("name"), F.create_map().cast("map<string,string>").alias("resource"),
        F.create_map(F.lit("kind"), F.col("event_type")).alias("attributes"), F.lit(1).cast("bigint").alias("as_int"),
        F.lit(None).cast("double").alias("as_double"))
    return _run(spark, jobs.metric_totals(raw), "update").groupBy("name", "labels").agg(F.max("value").alias("value"))


