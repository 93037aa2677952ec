"""Line, suffix and near-duplicate operators against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from actiontrail.llm import line_dedup, set_join, suffix_dedup
from actiontrail.llm.groups import components
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, keys string, n_lines string, kept string, root string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, None, "k", "l", "m", "r") for d, t in rows], SCHEMA).repartition(3)


def near_rows(seed=3, many=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "ñandú", "x"]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(4)]
    rows = []
    for i in range(many):
        w = rng.choice(base).split(" ")
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        a = rng.randrange(0, len(w) // 2)
        rows.append((i * 3, " ".join(w[a:a + rng.randrange(1, 150)])))
    return rows


def test_lines(spark):
    long = "A line that is long enough to count as a key, surely"
    rows = [(i, f"{long}\nown line {i}\n  {long.upper()}\t\n") for i in range(7)] + [
        (20, None), (21, ""), (22, "\n\n"), (None, f"{long}\nx"), (30, "short\n" * 5000 + long), (6, f"{long}\nown line 6\n  {long.upper()}\t\n"),
        (40, "É" * 40), (41, "É" * 40), (42, "é" * 40), (43, "É" * 40), (44, "É" * 40), (45, "É" * 39)]
    got = line_dedup.dedup(table(spark, rows))
    assert "lang" in got.columns and dict(got.dtypes)["n_lines"] == "bigint"
    found = sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=repr)
    assert found == sorted(plain.line_dedup(rows), key=repr)
    assert line_dedup.dedup(table(spark, [])).count() == 0


def test_levels_are_compacted(spark):
    store = line_dedup.RunStore(spark, fanout=2)
    for k in range(5):
        docs = table(spark, [(10 * k + i, f"{'w' * 45}{i}\n{'v' * 45}{k}") for i in range(3)])
        store.add(line_dedup.batch_keys(line_dedup.with_keys(docs.select("doc_id", "text"))))
    assert [len(x) for x in store.levels] == [1, 0, 1]
    totals = store.counts().collect()
    assert sorted(r.n_docs for r in totals) == [3] * 5 + [5] * 3
    # No key has two entries, which compaction and the final counts rely on.
    entries = store.entries(store.runs())
    assert entries.count() == entries.select(*line_dedup.HASHES).distinct().count() == 8
    # Updates met their entries when the levels were compacted: those of the first four batches are in no run any more.
    late = store.spark.read.parquet(*[run.updates for run in store.runs()]).collect()
    assert sorted(r.n_docs for r in late) == [1] * 3


def test_the_anti_join_decides(spark, monkeypatch):
    """Without it every batch opens entries for known keys, and lines of many documents are not found."""
    rows = [(i, f"{'s' * 50}\nown {i}") for i in range(30)]
    assert sum(r.n_dropped for r in line_dedup.dedup(table(spark, rows)).collect()) == 29
    add = line_dedup.RunStore.add
    monkeypatch.setattr(line_dedup.RunStore, "add", lambda self, batch: self._write(batch, batch.limit(0), 0))
    counts = line_dedup.build_store(line_dedup.with_keys(table(spark, rows).select("doc_id", "text"))).counts()
    assert counts.count() > 1 and add is not line_dedup.RunStore.add


def test_lines_with_clashing_columns(spark):
    rows = [(i, f"{'c' * 50}\n{i}") for i in range(6)]
    names = ["_hash", "_row", "_doc", "_own", "_gone", "_lines", "h1", "h2", "keys", "row_hash", "n_docs", "top_doc", "at", "N_LINES"]
    docs = table(spark, rows).selectExpr("*", *[f"{k} AS `{n}`" for k, n in enumerate(names)])
    got = line_dedup.dedup(docs)
    assert [r._hash for r in got.collect()] == [0] * 6 and sum(r.n_dropped for r in got.collect()) == 5
    assert set(names) - {"N_LINES"} <= set(got.columns)


def test_loser_tree():
    rng = random.Random(3)

    def shares(rows):
        out = []
        for i, row in enumerate(rows):
            k = 0
            while i and k < len(row) and row[k] == rows[i - 1][k]:
                k += 1
            out.append(k)
        return out

    for _ in range(40):
        runs = [sorted(bytes(rng.randrange(97, 100) for _ in range(12)) for _ in range(rng.randrange(0, 20))) for _ in range(rng.randrange(1, 9))]
        order, shared = suffix_dedup.merge([(r, shares(r)) for r in runs])
        flat = [x for r in runs for x in r]
        assert [flat[i] for i in order] == sorted(flat) and shared == shares(sorted(flat))


def test_front_coding():
    rows = np.sort(np.random.default_rng(2).integers(97, 99, (300, 100)).astype(np.uint8).view("S100").ravel()).view(np.uint8).reshape(-1, 100)
    back, shared = suffix_dedup.unpacked(*suffix_dedup.front_coded(rows))
    assert (back == rows).all() and (shared == suffix_dedup.common(rows)).all()


@pytest.mark.parametrize("heavy", [suffix_dedup.HEAVY, 1])
def test_suffixes(spark, heavy):
    rows = near_rows()
    rows += [(200, rows[3][1]), (201, rows[3][1]), (5, None), (7, ""), (8, "z" * 1000), (9, "z" * 99), (10, "z" * 100), (11, "ab" * 300 + "z" * 200),
             (13, "\0" * 120 + "ß" * 80), (14, "\0" * 150)]
    got = suffix_dedup.dedup(table(spark, rows), heavy)
    assert "lang" in got.columns and dict(got.dtypes)["kept"] == "binary"
    found = sorted(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())
    assert found == suffix_dedup.brute(rows)


def test_suffixes_of_repeated_rows(spark):
    rows = [(1, "q" * 50 + "r" * 60), (1, "q" * 50 + "r" * 60), (None, "q" * 50 + "r" * 60), (2, "short"), (2, "short"), (3, None)]
    found = sorted((tuple(r) for r in suffix_dedup.dedup(table(spark, rows)).select("doc_id", "n_removed").collect()), key=repr)
    assert found == sorted([(1, 110), (1, 110), (None, 0), (2, 0), (2, 0), (3, 0)], key=repr)
    assert suffix_dedup.dedup(table(spark, [])).count() == 0


@pytest.mark.parametrize("heavy", [suffix_dedup.HEAVY, 1])
def test_repeated_rows_keep_one(spark, heavy):
    long, other = "q" * 50 + "r" * 60, " ".join(f"word{k}" for k in range(40))
    rows = [(1, long), (1, long), (4, other), (4, other), (4, other), (6, other), (7, "x" + other[:150])]
    got = [tuple(r) for r in suffix_dedup.dedup(table(spark, rows), heavy).select("doc_id", "n_removed", "n_spans").collect()]
    n = len(other)
    assert sorted(got) == sorted([(1, 0, 0), (1, 110, 1), (4, 0, 0), (4, n, 1), (4, n, 1), (6, n, 1), (7, 150, 1)])


def test_suffixes_over_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(tuple(r) for r in suffix_dedup.dedup_report(docs).collect())
    assert got == suffix_dedup.brute([(r.doc_id, r.text) for r in docs.collect()])


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)]
    up = {x: x for e in edges if e[0] != e[1] for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    got = sorted(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == sorted((x, root(x)) for x in up)


def changed(rng, words, at):
    out = list(words)
    for k in at:
        out[k] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_classes(spark):
    rng = random.Random(4)
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one two"), (9, "one  two"), (10, "one three")]
    for group in range(8):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        rows += [(100 * group + 20 + k, changed(rng, words, rng.sample(range(120), k % 4))) for k in range(12)]
    got = sorted(tuple(r) for r in set_join.class_report(table(spark, rows)).collect())
    assert got == sorted(plain.classes(rows))
    kept = set_join.first_of_classes(table(spark, [*rows, rows[-1]]))
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(ids) == sorted({c for _, c, _ in plain.classes(rows)}) and "lang" in kept.columns
    assert set_join.class_report(table(spark, [])).count() == 0


def test_recall_of_one_sketch():
    # Pairs at the threshold: shared coordinates are drawn first, then each run holds the pair or not.
    rng = np.random.default_rng(5)
    runs = set_join.runs_needed()
    k = rng.binomial(set_join.WIDTH, set_join.THRESHOLD, 4_000_000)
    chance = np.array([1 - set_join.survival(set_join.MAX_DEPTH, x / set_join.WIDTH) for x in range(set_join.WIDTH + 1)]) ** runs
    least = set_join.WIDTH * 0.8 - set_join.SLACK * (set_join.WIDTH * 0.8 * 0.2) ** 0.5
    assert np.where(k < least, 1.0, chance[k]).mean() <= 1 - set_join.RECALL


def test_large_groups_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(set_join, "TILE", 8)
    monkeypatch.setattr(set_join, "BUCKET", 8)
    rng = random.Random(6)
    words = [f"w{k}" for k in range(150)]
    rows = [(k, changed(rng, words, rng.sample(range(150), k % 3))) for k in range(60)]
    rows = list({t: (d, t) for d, t in rows}.values())
    nodes = sorted(tuple(r) for r in set_join.class_report(table(spark, rows)).collect())
    assert nodes == sorted(plain.classes(rows))


def test_null_ids_and_repeats(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (1, text), (None, text), (2, "all other words stand here now")]
    got = sorted((tuple(r) for r in set_join.class_report(table(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, 1, 2), (1, 1, 2), (None, 1, 2), (2, 2, 0)], key=repr)


def test_digest_of_lines(spark):
    got = line_dedup.dedup_report(table(spark, [(1, None)])).collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, hashlib.sha256(b"").hexdigest())]


def test_clashing_names_in_public_functions(spark):
    """Every name that the operators use inside, as columns of the documents."""
    import re
    from pathlib import Path

    names = {"_hash", "_doc", "_d", "_h", "_h1", "_size", "_nth", "_late", "_text_hash", "found", "whole", "places", "key", "root", "node", "low", "class_id",
             "pick", "own", "other_columns_2"}
    for module in (suffix_dedup, set_join):
        names |= set(re.findall(r'(?:alias|withColumn)\("([A-Za-z_0-9]+)"', Path(module.__file__).read_text()))
    names = sorted(names - {"doc_id", "text", "kept", "n_bytes", "n_removed", "n_spans"})
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (2, text), (3, f"{text} more"), (4, "other words of this text here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"{k} AS `{n}`" for k, n in enumerate(names)])
    got = suffix_dedup.dedup(docs)
    assert got.columns == [*docs.columns, "kept", "n_bytes", "n_removed", "n_spans"]
    assert {r.doc_id: r.n_removed > 0 for r in got.collect()} == {1: False, 2: True, 3: True, 4: False, None: False}
    first = set_join.first_of_classes(docs)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == {1, 4, None}
    assert all(r[name] == k for r in first.collect() for k, name in enumerate(names))
