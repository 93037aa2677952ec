"""Lines appended to known files, rotation, truncation, oversize records; one-pass lines and digests."""

import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from actiontrail.sources import appended, lines
from actiontrail.streaming import jobs


def test_split_lines():
    rng = random.Random(1)
    for _ in range(300):
        data = bytes(rng.choice(b"ab\n\r") for _ in range(rng.randrange(60)))
        cuts = sorted(rng.randrange(len(data) + 1) for _ in range(5))
        chunks = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        got = list(appended.split_lines(chunks))
        whole = data.split(b"\n")
        assert [x[1] for x in got if x[3]] == [x.removesuffix(b"\r") for x in whole[:-1]]
        assert [x[1] for x in got if not x[3]] == ([whole[-1]] if whole[-1] else [])
        assert all(data[at:at + n] == (line or b"") or data[at:at + n] == line + b"\r" for at, line, n, _ in got)
        capped = list(appended.split_lines(chunks, max_bytes=2))
        assert [(a, n) for a, _, n, _ in capped] == [(a, n) for a, _, n, _ in got]
        assert all((line is None) == (n > 2) for _, line, n, _ in capped)


class Follower:
    def __init__(self, spark, folder, **options):
        spark.dataSource.register(appended.AppendedLines)
        self.spark, self.folder, self.options, self.turn = spark, folder, {"path": f"{folder}/*.log*", **options}, 0

    def run(self):
        """New rows of one run of the query, from its checkpoint."""
        self.turn += 1
        out = f"{self.folder}/out-{self.turn}"
        rows = self.spark.readStream.format("appended_lines").options(**self.options).load()
        query = jobs.start(rows, f"{self.folder}/checkpoint", lambda df, _: df.write.mode("append").parquet(out))
        assert query.awaitTermination(300) and query.exception() is None
        found = self.spark.read.schema(appended.SCHEMA).parquet(out).collect() if os.path.isdir(out) else []
        return sorted(((r.value, r.n_bytes) if r.value is None else r.value for r in found), key=str)


def write(path, text, mode="a"):
    with open(path, mode) as file:
        file.write(text)


def test_appended_rotated_and_truncated(spark, tmp_path):
    log, follow = f"{tmp_path}/a.log", Follower(spark, tmp_path)
    write(log, "one\ntwo\nthr")
    assert follow.run() == ["one", "two"]
    assert follow.run() == []
    write(log, "ee\nfour\n")
    assert follow.run() == ["four", "three"]
    # Rotation: the rest of the renamed file and the whole new one.
    write(log, "five\n")
    os.rename(log, f"{log}.1")
    write(f"{log}.1", "six\n")
    write(log, "new one\n")
    assert follow.run() == ["five", "new one", "six"]
    # The same file cut and written again, shorter, longer and as long as before.
    write(log, "x\n", "w")
    assert follow.run() == ["x"]
    write(log, "longer than it was before\nand more\n", "w")
    assert follow.run() == ["and more", "longer than it was before"]
    write(log, "longer than it was bEfore\nand mOre\n", "w")
    assert follow.run() == ["and mOre", "longer than it was bEfore"]
    os.remove(f"{log}.1")
    write(log, "end\n")
    assert follow.run() == ["end"]


def test_oversize_and_splits(spark, tmp_path):
    follow = Follower(spark, tmp_path, split_bytes="7", max_record_bytes="10")
    texts = [f"line {i}" for i in range(50)] + ["", "é" * 4, "y" * 10]
    write(f"{tmp_path}/b.log", "".join(t + "\n" for t in texts) + "z" * 3000 + "\n" + "last\n")
    got = follow.run()
    assert sorted(x for x in got if isinstance(x, str)) == sorted([*texts, "last"])
    assert [x for x in got if not isinstance(x, str)] == [(None, 3000)]


def test_deliver_counts_oversize(spark, tmp_path):
    spark.dataSource.register(appended.AppendedLines)
    write(f"{tmp_path}/c.log", "ok\n" + "w" * 500 + "\n")
    rows = spark.readStream.format("appended_lines").options(path=f"{tmp_path}/c.log", max_record_bytes="100").load()
    kept, large = [], []
    query = jobs.deliver(rows, f"{tmp_path}/cp", {"http": lambda df: kept.extend(r.value for r in df.collect())}, max_bytes=100,
                         oversize=lambda df: large.append(df.agg(F.sum("n_bytes")).first()[0]), size="n_bytes")
    assert query.awaitTermination(300) and kept == ["ok"] and large == [500]


TREE = {"a.jsonl": b"one\r\ntwo\n\nlast", "b.jsonl": b"", "c.jsonl": b"\n\n", "sub/d.jsonl": "é\n".encode() * 500, "e.jsonl": b"x" * 3000 + b"\ny\n"}


@pytest.mark.parametrize("buffer", [100, 1 << 20])
def test_hashed_lines(spark, tmp_path, buffer):
    for name, data in TREE.items():
        path = tmp_path / "home" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    packed = gzip.compress(b"p\nq\n")
    (tmp_path / "home/f.jsonl.gz").write_bytes(packed)
    root = f"{tmp_path}/home"
    got, notes = lines.hashed_lines(spark, root, buffer_bytes=buffer)
    rows = sorted((r.local_path, r.line, r.raw, r.sha256) for r in got.collect())
    plain, _ = lines.numbered_lines(spark, root)
    assert rows == sorted((r.local_path, r.line, r.raw, r.sha256) for r in plain.collect())
    assert {(p, s) for p, _, _, s in rows if p.endswith("gz")} == {(f"{root}/f.jsonl.gz", hashlib.sha256(packed).hexdigest())}
    assert notes.count() == 0
    short, notes = lines.hashed_lines(spark, root, max_line_bytes=100, max_file_bytes=3001, buffer_bytes=buffer)
    assert {(r.path.rsplit("/", 1)[1], r.line) for r in notes.collect()} == {("e.jsonl", None)}
    assert short.count() == len(rows) - 2
    _, notes = lines.hashed_lines(spark, root, max_line_bytes=100, buffer_bytes=buffer)
    assert {(r.path.rsplit("/", 1)[1], r.line) for r in notes.collect()} == {("e.jsonl", 1)}


def test_a_file_over_two_gigabytes(spark, tmp_path):
    """Larger than a cell can be; each byte is read once and none is held."""
    line, many, digest = b"x" * ((1 << 20) - 1) + b"\n", 2200, hashlib.sha256()
    with open(tmp_path / "big.jsonl", "wb") as out:
        for _ in range(many):
            out.write(line)
            digest.update(line)
    got, notes = lines.hashed_lines(spark, str(tmp_path), max_line_bytes=1000)
    assert notes.count() == many and got.count() == 0
    facts = lines.file_facts(spark, str(tmp_path), max_line_bytes=1000).first()
    assert (facts.n_lines, facts.n_bytes, facts.sha256) == (many, many << 20, digest.hexdigest())
