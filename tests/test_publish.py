"""Cases that appear whole or not at all; the first keys of a run without a global order."""

import hashlib
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from actiontrail.operators import cases, indicators


@pytest.fixture()
def root():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def rows(spark):
    return {"events": spark.range(20).select(F.col("id").cast("string").alias("event_id")), "findings": spark.range(3).selectExpr("id AS finding_id")}


def test_a_case_is_published_once(spark, root):
    listed = cases.publish_case(rows(spark), root, "c-1")
    assert {r.path.split("/")[0]: 0 for r in listed.collect()}.keys() == {"events", "findings"}
    assert listed.agg(F.sum("row_count")).first()[0] == 23 and cases.verify_case(spark, root, "c-1", ["events", "findings"]).count() == 0
    with pytest.raises(FileExistsError):
        cases.publish_case(rows(spark), root, "c-1")
    for bad in ("", "../x", "a/b", ".hidden"):
        with pytest.raises(ValueError):
            cases.publish_case(rows(spark), root, bad)
    folder = cases.case_folder(spark, root, "c-1") + "/events"
    part = next(f for f in sorted(os.listdir(folder)) if f.startswith("part-"))
    with open(f"{folder}/{part}", "a") as file:
        file.write("{}\n")
    os.remove(f"{folder}/.{part}.crc")
    assert [r.problem for r in cases.verify_case(spark, root, "c-1", ["events", "findings"]).collect()] == ["digest_mismatch"]


def test_long_files_are_not_read_whole(spark, root, monkeypatch):
    """Files are bounded in rows when written; one above FILE_BYTES is hashed line by line, to the same digest."""
    monkeypatch.setattr(cases, "FILE_ROWS", 100)
    monkeypatch.setattr(cases, "FILE_BYTES", 3000)
    text = F.when(F.col("id") < 900, "x").otherwise(F.repeat(F.lit("\u00e9\r"), 40))
    listed = cases.write_case({"events": spark.range(1000).coalesce(1).select("id", text.alias("t"))}, root).collect()
    assert len(listed) == 10 and all(r.row_count == 100 for r in listed)
    with open(f"{root}/events/part-odd", "wb") as file:  # no end of line at its end, one empty line, bytes that are no text
        file.write(b"\n" + b"\xff\x00" * 2000 + b"\r\n" + b"y" * 10)
    found = {r.path: r.sha256 for r in cases.manifest(spark, root, ["events"]).collect()}
    sizes = {p: os.path.getsize(f"{root}/{p}") for p in found}
    assert len(found) == 11 and min(sizes.values()) <= 3000 < max(sizes.values())
    for path, digest in found.items():
        with open(f"{root}/{path}", "rb") as file:
            assert hashlib.sha256(file.read()).hexdigest() == digest, path


def test_a_killed_write_leaves_no_case(spark, root, monkeypatch):
    dies = rows(spark) | {"decisions": spark.range(5).select(F.raise_error(F.lit("killed")).cast("string").alias("x"))}
    with pytest.raises(Exception, match="killed"):
        cases.publish_case(dies, root, "c-2")
    assert os.listdir(f"{root}/staging")
    with pytest.raises(FileNotFoundError):
        cases.case_manifest(spark, root, "c-2")

    # Two writers at once: the second finds the name taken when it wants to publish.
    monkeypatch.setattr(cases, "exists", lambda *_: False)
    monkeypatch.setattr(cases, "case_manifest", lambda *_: None)
    cases.publish_case(rows(spark), root, "c-2")
    with pytest.raises(FileExistsError):
        cases.publish_case(rows(spark), root, "c-2")


@pytest.mark.parametrize(("seed", "bins"), [(1, 5), (3, 1024)])
def test_earliest_keys(spark, seed, bins):
    rng = random.Random(seed)
    made = [("url", f"v{i}", rng.choice((rng.randrange(50), rng.randrange(10**12), 7)), rng.choice((1, 2, 2**62, 5)), rng.randrange(3)) for i in range(600)]
    keys = spark.createDataFrame(made, "type string, value string, seq long, place long, pos int")
    order = sorted(made, key=lambda r: (r[2], r[3], r[4], r[0], r[1]))
    for limit in (1, 333, 600):
        got = sorted(r.value for r in indicators.earliest_keys(keys, limit, bins).collect())
        assert got == sorted(r[1] for r in order[:limit]), limit
    assert indicators.earliest_keys(keys.limit(0), 5).count() == 0
