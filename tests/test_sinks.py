"""Sinks under retries; eviction of idle groups and changed rule sets; numbering in order."""

import random
import tempfile
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from actiontrail.operators.chains import ChainRule
from actiontrail.operators.positions import number_in_order
from actiontrail.streaming import jobs
from actiontrail.streaming.sinks import CommittedSink


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def run(query, seconds=180):
    try:
        done = query.awaitTermination(seconds)
    finally:
        query.stop()
    assert done


def numbers(spark, folder, first, last):
    spark.range(first, last).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_a_batch_that_is_run_again_counts_once(spark, folder):
    calls = []

    def die_once(batch):
        calls.append(batch)
        if len(calls) == 1:
            raise OSError("between write and commit")

    sink = CommittedSink(f"{folder}/out", before_commit=die_once)
    rows = lambda: spark.readStream.schema("id long").parquet(f"{folder}/in")
    assert sink.read(spark, "id long").count() == 0
    numbers(spark, folder, 0, 10)
    with pytest.raises(StreamingQueryException):
        run(jobs.start(rows(), f"{folder}/ck", sink.write))
    assert sink.read(spark, "id long").count() == 0 and spark.read.parquet(f"{folder}/out/data").count() == 10
    run(jobs.start(rows(), f"{folder}/ck", sink.write))
    assert calls == [0, 0] and sorted(r.id for r in sink.read(spark, "id long").collect()) == list(range(10))
    assert spark.read.parquet(f"{folder}/out/data").count() == 20

    # Written and committed, but Spark does not hear of it.
    def then_die(df, batch):
        sink.write(df, batch)
        raise OSError("after commit")

    numbers(spark, folder, 10, 15)
    with pytest.raises(StreamingQueryException):
        run(jobs.start(rows(), f"{folder}/ck", then_die))
    run(jobs.start(rows(), f"{folder}/ck", sink.write))
    assert sorted(r.id for r in sink.read(spark, "id long").collect()) == list(range(15)) and calls == [0, 0, 1]


def test_delivery_to_several_committed_sinks(spark, folder):
    def down(_):
        raise OSError("down")

    good, bad = CommittedSink(f"{folder}/a"), CommittedSink(f"{folder}/b", before_commit=down)
    rows = lambda: spark.readStream.schema("value string").text(f"{folder}/in")
    spark.createDataFrame([("a",), ("b",)], "value string").coalesce(1).write.text(f"{folder}/in")
    with pytest.raises(StreamingQueryException):
        run(jobs.deliver(rows(), f"{folder}/ck", {"a": good, "b": bad}))
    run(jobs.deliver(rows(), f"{folder}/ck", {"a": good, "b": CommittedSink(f"{folder}/b")}))
    assert [CommittedSink(f"{folder}/{n}").read(spark, "value string").count() for n in "ab"] == [2, 2]


EVENTS = ("source_agent string, source_type string, session_id string, project_path string, seq long, event_id string, timestamp string, "
          "event_type string, evidence struct<local_path:string>")


def events(spark, folder, rows):
    made = [("codex", "hook", group, None, seq, f"e{seq}", f"2026-01-01T00:00:{seq:02d}Z", kind, None) for group, seq, kind in rows]
    spark.createDataFrame(made, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def chains(spark, folder, rule, version, ttl_ms=None, wait=0):
    live = spark.readStream.schema(EVENTS).parquet(f"{folder}/in")
    sink = CommittedSink(f"{folder}/out")
    found = jobs.stateful_chains(live, [rule], version, ttl_ms, evictions=ttl_ms is not None)
    query = jobs.start(found, f"{folder}/ck", sink.write, every=None if ttl_ms is None else "1 second")
    if ttl_ms is None:
        run(query)
    else:
        # Timers always have a batch to come, so the query is stopped some batches after the one that read rows.
        until = time.time() + 60
        while time.time() < until and query.exception() is None:
            counts = [p.numInputRows for p in query.recentProgress]
            if wait or (sum(counts) and counts[-1] == 0):
                break
            time.sleep(0.5)
        time.sleep(wait)
        query.stop()
    return sink.read(spark, found.schema)


def test_idle_groups_leave_the_state(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS)
    rule = ChainRule("r", (F.col("event_type") == "a", F.col("event_type") == "b"), 10, None, 5)
    ttl = 12_000
    events(spark, folder, [("idle", 1, "a"), ("busy", 2, "a")])
    assert chains(spark, folder, rule, "v1", ttl).count() == 0
    held = jobs.held_groups(spark, f"{folder}/ck").collect()
    assert len(held) == 2
    time.sleep(4)
    events(spark, folder, [("busy", 3, "b"), ("busy", 4, "a")])
    assert [tuple(r.cited_event_ids) for r in chains(spark, folder, rule, "v1", ttl).where("rule_id IS NOT NULL").collect()] == [("e2", "e3")]
    # The idle group's time runs out; the other one's began anew.
    found = chains(spark, folder, rule, "v1", ttl, wait=9)
    gone = [r.cited_event_ids for r in found.where("rule_id IS NULL").collect()]
    left = {r.group for r in jobs.held_groups(spark, f"{folder}/ck").collect()}
    assert len(gone) == 1 and gone[0][1] == "1" and len(left) == 1 and gone[0][0] not in left
    assert jobs.evicted_total(found).first().value == 1.0
    # What was dropped completes nothing any more.
    events(spark, folder, [("idle", 5, "b")])
    assert not [r for r in chains(spark, folder, rule, "v1", ttl).collect() if "e1" in r.cited_event_ids]


def test_old_windows_never_complete_another_rule_set(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKS)
    before = ChainRule("old", (F.col("event_type") == "a", F.col("event_type") == "b"), 10, None, 5)
    after = ChainRule("new", (F.col("event_type") == "a", F.col("event_type") == "c"), 10, None, 5)
    events(spark, folder, [("g", 1, "a")])
    assert chains(spark, folder, before, "v1").count() == 0
    # The same query over a restart, with other rules: "a" was seen under the old ones.
    events(spark, folder, [("g", 2, "c"), ("g", 3, "a"), ("g", 4, "c")])
    assert [(r.rule_id, r.cited_event_ids) for r in chains(spark, folder, after, "v2").collect()] == [("new", ["e3", "e4"])]
    assert {r.rules for r in jobs.held_groups(spark, f"{folder}/ck").collect()} == {"v1", "v2"}


def test_number_in_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randrange(1000), None if i % 7 else i) for i in range(500)]
    got = number_in_order(spark.createDataFrame(rows, "k string, v int, x int"), ["k", "v"], "n", 7).collect()
    assert sorted(r.n for r in got) == list(range(1, 501))
    assert [(r.k, r.v) for r in sorted(got, key=lambda r: r.n)] == sorted((k, v) for k, v, _ in rows)
