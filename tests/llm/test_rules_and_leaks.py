"""Quality rules, decontamination, sharding and the pipeline."""

import collections
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from actiontrail.llm import decontaminate, quality, sharding
from actiontrail.llm.fm_index import FMIndex, suffix_order
from actiontrail.llm.shared import saved
from actiontrail.llm.text_bytes import texts
from actiontrail.llm.trees import fit
from tests.llm import plain

ODD = [None, "", " \n\t", "one", "a\x1cb c d", "x " * 40, "ñ é # * $\n\nsame line\nsame line\n \nsame line ", "w " * 7, "w " * 8, "w " * 9,
       " ".join(f"t{k}" for k in range(30)) + "\n" + " ".join(f"t{k}" for k in range(20)), "| <b> & %" * 5, "é" * 3000 + " " + "y" * 200_000]


def test_statistics():
    got = quality.statistics(*texts(pa.array(ODD)))
    assert [tuple(r[:5]) for r in got.tolist()] == [plain.statistics(t) for t in ODD]
    assert quality.statistics(*texts(pa.array([], pa.string()))).shape == (0, len(quality.COUNTS))


def test_trees_are_monotone_and_learn():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.4) & (x[:, 1] < 0.7)) ^ (rng.random(3000) < 0.05)
    model = fit(x[:2000], y[:2000].astype(float), monotone={0: 1, 1: -1})
    assert np.mean((model.score(x[2000:]) > 0.5) == y[2000:]) > 0.9
    grid = np.repeat(x[:50], 40, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(model.raw(grid).reshape(50, 40), axis=1) >= -1e-9).all()
    grid[:, 1] = np.tile(np.linspace(0, 1, 40), 50)
    grid[:, 0] = np.repeat(x[:50, 0], 40)
    assert (np.diff(model.raw(grid).reshape(50, 40), axis=1) <= 1e-9).all()


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    held = quality.judge(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), model).where("NOT base_failed").select("quality", "kept").collect()
    assert len(held) > 100 and np.mean([r.kept == (r.quality == 1) for r in held]) > 0.95


def test_judge_edges(spark):
    docs = spark.createDataFrame([(i, t, "old", 1.5) for i, t in enumerate(ODD)] + [(None, "word " * 3, "old", None)],
                                 "doc_id long, text string, kept string, n_words double")
    got = quality.judge(docs, None)
    assert dict(got.dtypes)["kept"] == "boolean" and got.where("doc_id IS NULL").first().base_failed
    for r in got.where("doc_id IS NOT NULL").collect():
        words, repeated = plain.statistics(ODD[r.doc_id])[0], plain.statistics(ODD[r.doc_id])[4]
        assert r.base_failed == (words < 20 or 100 * repeated > 30 * words) and r.kept == (not r.base_failed)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, none) is None
    assert quality.judge(docs.where("false"), None).count() == 0


def test_fm_index():
    rng = np.random.default_rng(1)
    for n in (1, 5, 50, 3000):
        text = rng.integers(0, 4, n)
        text[-1] = 0
        zeros = np.flatnonzero(text == 0)
        key = lambda i: [(int(x), 0) for x in text[i:zeros[np.searchsorted(zeros, i)]]] + [(0, int(zeros[np.searchsorted(zeros, i)]))]  # noqa: B023,E731
        assert list(suffix_order(text)) == sorted(range(n), key=key)
        index = FMIndex(text, 4)
        wanted = [[1], [2, 3], [1, 1, 2], [3, 3, 3, 1]]
        table = np.zeros((4, 4), int)
        for k, p in enumerate(wanted):
            table[k, 4 - len(p):] = p
        found, low, high = index.search(table, np.array([len(p) for p in wanted]))
        got = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(found, low, high)}
        want = {k: [i for i in range(n - len(p) + 1) if list(text[i:i + len(p)]) == p] for k, p in enumerate(wanted)}
        assert got == {k: v for k, v in want.items() if v}


def leaks(spark):
    items = [(1, "The quick brown fox jumps over the lazy dog near the river bank"), (2, "short phrase here"), (2, "Ünïcode words"), (3, None), (4, "..."),
             (None, "solo"), (5, "the quick brown fox jumps over the lazy dog near"), (6, "a a a a a a a a a a a a")]
    docs = [(1, "Well: THE QUICK brown-fox jumps over the lazy dog near the river, bank!"), (2, "short phrase\nhere"), (3, None), (4, ""), (5, "solo"),
            (6, "quick brown fox jumps over the lazy dog near the"), (7, "so Ünïcode WORDS; " * 3), (8, "a " * 25), (9, "nothing at all"), (9, "nothing at all"),
            (None, "xx solo yy " + "z" * 100_000)]
    return (spark.createDataFrame([(i, t, "e") for i, t in items], "item_id long, text string, extra string"), items,
            spark.createDataFrame([(d, t, "s", 2) for d, t in docs], "doc_id long, text string, spans string, n_hit int"), docs)


def test_leaks(spark):
    bench, items, table, docs = leaks(spark)
    windows = plain.benchmark_windows(items)
    want = []
    for doc, text in docs:
        words, cover, found = plain.hits(text, windows)
        want.append((doc, len(words), len(cover), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(cover)))
    got = decontaminate.contamination_report(table, bench).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    blocks = decontaminate.search(table, bench, block_words=1).select("doc_id", "n_hit", "items").collect()
    assert sorted(((r.doc_id, r.n_hit, len(r.items)) for r in blocks), key=repr) == sorted(((w[0], w[2], w[3]) for w in want), key=repr)
    assert decontaminate.contamination_report(table, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination_report(table.where("false"), bench).count() == 0


def test_cut_spans(spark):
    bench, items, table, docs = leaks(spark)
    kept = {r.doc_id: r.text for r in decontaminate.without_spans(decontaminate.search(table, bench)).collect()}
    assert kept[1] == "Well: !" and kept[9] == "nothing at all" and 6 not in kept and 5 not in kept and 2 not in kept
    assert kept[7].split() == ["so", ";", "so", ";", "so", ";"] and kept[3] is None


def test_sharding(spark):
    rows = [(i, f"text {i} " * (i % 17)) for i in range(400)] + [(None, None), (1, None), (1, None), (5, "big " * 20_000)]
    docs = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, shard int")
    got = sharding.shard_documents(docs).collect()
    assert sorted((r["size"], r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    places, load = collections.defaultdict(list), collections.Counter()
    for r in got:
        places[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert set(places) == set(range(8)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    where = collections.defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    rest = [n for n in load.values() if n < 80_000]
    assert max(rest) - min(rest) < 400
    assert sharding.shard_documents(docs.where("false")).count() == 0


def test_large_group_of_copies_is_spread(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the same text in half of all rows").otherwise(
        F.concat(F.lit("an own text with number "), F.col("id").cast("string"))).alias("text"))
    load = collections.Counter()
    for r in sharding.shard_documents(docs).collect():
        load[r.shard] += r["size"]
    assert len(load) == 8 and max(load.values()) - min(load.values()) < 200


def test_rebalancing_moves_little():
    rng = np.random.default_rng(3)
    sizes = dict(enumerate(rng.integers(1, 1000, 4096).tolist()))
    old = sharding.first_map(sizes, 8, 4096)
    new = sharding.rebalanced(old, sizes, 9)
    moved = [v for v in old if old[v] != new[v]]
    load = collections.Counter()
    for v, s in new.items():
        load[s] += sizes[v]
    assert all(new[v] == 8 for v in moved) and max(load.values()) - min(load.values()) < 3000
    fewer = sharding.rebalanced(new, sizes, 8)
    assert set(fewer.values()) == set(range(8)) and all(fewer[v] == new[v] for v in new if new[v] != 8)


def test_pipeline_against_plain(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frame, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        frame = saved(stage(spark, frame, sf), name)
        seen.append(frame)
    assert all(f.columns == docs.columns for f in seen[:-1])
    table = lambda f: sorted((r.doc_id, r.text) for r in f.collect())
    start, kept, lines, near, clean = table(docs), *map(table, seen[:4])
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    counts = quality.statistics(*texts(pa.array([t for _, t in start])))
    score = model.score(quality.features(counts))
    assert kept == [row for row, c, s in zip(start, counts.tolist(), score) if c[0] >= 20 and 100 * c[4] <= 30 * c[0] and s >= quality.KEEP_FROM]
    assert lines == sorted((d, t) for d, _, _, t in plain.line_dedup(kept))
    firsts = {c for _, c, _ in plain.classes(lines)}
    assert near == [row for row in lines if row[0] in firsts]
    windows = plain.benchmark_windows([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    want = []
    for doc, text in near:
        words, cover, _ = plain.hits(text, windows)
        if not cover or len(cover) < len(words):
            want.append((doc, [w for k, w in enumerate(words) if k not in cover]))
    assert [(d, decontaminate.brute_words(t)) for d, t in clean] == want
    assert all(r.n_chars == len(r.text) for r in seen[3].collect())
    assert {r.doc_id for r in seen[4].collect()} == {d for d, _ in clean}
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
