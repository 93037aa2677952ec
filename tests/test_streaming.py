"""Streams give what the batch gives; waits are bounded."""

import tempfile

import pytest
from pyspark.sql import functions as F

from actiontrail.operators import indicators as ind
from actiontrail.operators.chains import ChainRule, chain_matches
from actiontrail.plans.adapters import actions, texts
from actiontrail.sources.records import FanOutError, fan_out
from actiontrail.streaming import jobs


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def finish(query, seconds=120):
    done = query.awaitTermination(seconds)
    query.stop()
    assert done, "stream did not end in time"


def sink(folder, name):
    return lambda df, _=0: df.write.mode("append").parquet(f"{folder}/{name}")


def staged(spark, df, folder, parts=3):
    df.repartitionByRange(parts, "seq").write.parquet(f"{folder}/in")
    return jobs.read_files(spark, f"{folder}/in", df.schema, files_per_batch=1)


def test_stateful_chains_equal_batch(spark, sf_dir, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS)
    df = actions(spark, sf_dir).withColumns({"source_type": F.lit("hook"), "source_agent": F.lit("codex"),
                                             "project_path": F.lit(None).cast("string")})
    rules = [ChainRule("a", (F.col("event_type") == "config.agent", F.col("event_type") == "command.exec"), 10, None, 3),
             ChainRule("b", (F.col("event_type") == "config.agent", F.col("event_type") == "file.read",
                             F.col("event_type") == "command.exec"), None, 86400.0, 2)]
    # Files hold ascending slices of the arrival order, one per micro-batch.
    top = df.agg(F.max("seq")).first()[0]
    for i in range(3):
        df.where(F.floor(F.col("seq") * 3 / (top + 1)) == i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = jobs.read_files(spark, f"{folder}/in", df.schema, files_per_batch=1)
    finish(jobs.start(jobs.stateful_chains(stream, rules, "v1"), f"{folder}/ck", sink(folder, "out")))
    key = lambda rows: sorted((r.rule_id, tuple(r.cited_event_ids)) for r in rows)
    got = key(spark.read.parquet(f"{folder}/out").collect())
    assert got and got == key(chain_matches(df, rules).collect())


def test_detect_and_redelivery(spark, sf_dir, folder):
    from actiontrail.operators import rules as R

    df = actions(spark, sf_dir)
    rules = [r for r in R.load_rules() if r.id in ("secrets.agent_read_env", "recon.cloud_metadata")]
    df.unionByName(df).coalesce(2).write.parquet(f"{folder}/in")
    stream = jobs.read_files(spark, f"{folder}/in", df.schema).withColumn("clock", F.to_timestamp("timestamp"))
    once = jobs.once_per_id(stream, "clock", "40 days").drop("clock")
    finish(jobs.start(jobs.detect(once, rules), f"{folder}/ck", sink(folder, "out")))
    got = {r.finding_id for r in spark.read.parquet(f"{folder}/out").collect()}
    rows = spark.read.parquet(f"{folder}/out").count()
    want = R.matches(df, rules).count()
    assert rows == want == len(got) > 0


def test_indicator_updates(spark, sf_dir, folder):
    df = texts(spark, sf_dir)
    stream = staged(spark, df, folder)
    finish(jobs.start(jobs.indicator_totals(stream), f"{folder}/ck", sink(folder, "out"), mode="update"))
    last = spark.read.parquet(f"{folder}/out").groupBy("type", "value").agg(F.max("count").alias("count"))
    want = ind.indicators(df).select("type", "value", "count")
    assert last.exceptAll(want).count() == 0 and want.exceptAll(last).count() == 0


def test_delivery_resumes_and_survives_a_bad_sink(spark, folder):
    spark.createDataFrame([("a",), ("b",)], "value string").coalesce(1).write.text(f"{folder}/in")
    read = lambda: spark.readStream.schema("value string").text(f"{folder}/in")
    ok = {"ok": lambda df: df.write.mode("append").text(f"{folder}/out")}
    finish(jobs.deliver(read(), f"{folder}/ck", ok))
    spark.createDataFrame([("c",)], "value string").coalesce(1).write.mode("append").text(f"{folder}/in")
    finish(jobs.deliver(read(), f"{folder}/ck", ok))
    assert sorted(r.value for r in spark.read.text(f"{folder}/out").collect()) == ["a", "b", "c"]

    def bad(_):
        raise OSError("down")

    with pytest.raises(FanOutError) as err:
        fan_out(spark.range(2).select(F.col("id").cast("string").alias("value")), {"bad": bad, **ok})
    assert list(err.value.failures) == ["bad"]
    assert spark.read.text(f"{folder}/out").count() == 5


def test_fingerprint_changes_with_rules():
    from actiontrail.operators.rules import Rule

    rule = Rule("a", "1", "t", "low", steps=("x", "y"), within_events=5)
    other = Rule("a", "1", "t", "low", steps=("x", "z"), within_events=5)
    assert jobs.fingerprint([rule]) != jobs.fingerprint([other])
