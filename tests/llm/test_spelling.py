"""Spelling variants against all pairs of words."""

import collections
import random
import re
import zlib

import pytest

from actiontrail.llm import spelling

LOWER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows):
    out = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = 1 if doc is None else zlib.crc32(f"{doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def brute(words):
    around = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and near(w, v)] for w in words}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(around[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("most_pairs", [1, 6, 4096])
def test_all_pairs(spark, most_pairs):
    rng = random.Random(most_pairs)
    words = {"".join(rng.choices("abé", k=rng.choice((1, 2, 3, 5, 5, 6, 7)))): rng.choice((1, 1, 2, 5, 20, 90)) for _ in range(700)}
    words |= {"aaaaa": 4, "aaaaaa": 9, "aaaaaaa": 18, "aaaaaaaa": 36, "x" * 3000: 1, "x" * 3001: 2, "x" * 1500 + "y" + "x" * 1500: 4}
    assert got(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), most_pairs)) == brute(words)


def test_a_pair_counts_once(spark):
    words = spark.createDataFrame([("aabbaab", 1), ("aabbbaab", 1), ("aaabbaab", 1), ("bbbbb", 1), ("bbbbbb", 1)], "word string, n long")
    for most in (0, 100):
        pairs = spelling.near_pairs(words, most).collect()
        assert sorted((r.x, r.y) for r in pairs) == [
            ("aaabbaab", "aabbbaab"), ("aabbaab", "aaabbaab"), ("aabbaab", "aabbbaab"), ("bbbbb", "bbbbbb")]


def test_common_chunks_do_not_meet_as_pairs(spark, monkeypatch):
    """3,000 words with one first half: 9 million pairs if the chunk were joined."""
    rng, meetings, joined = random.Random(5), [], spelling._joined

    def watched(rows):
        sides = rows.groupBy(*spelling.KEY, "grams").count().groupBy(*spelling.KEY).pivot("grams", [False, True]).sum("count")
        meetings.append(sides.selectExpr("sum(`false` * `true`)").first()[0] or 0)
        return joined(rows)

    monkeypatch.setattr(spelling, "_joined", watched)
    words = {"prefixes" + "".join(rng.choices("abcdefghij", k=8)): 1 for _ in range(3000)} | {"prefixesabcdefgh": 9}
    pairs = spelling.near_pairs(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert pairs.count() == sum(near(a, b) for a in words for b in words if a < b)
    assert sum(meetings) < 100_000


ROWS = [(i, "Colour color COLOR colors ÀÉÎÕ× naïve naive Naïve don't re-enter x1y2zword") for i in range(40)] + [
    (3, "colour"), (3, "colour"), (None, "colour color"), (None, None), (50, None), (51, ""), (52, "long Words wordz " * 5000), (53, "q" * 100_000)]


def test_report(spark):
    docs = spark.createDataFrame([(d, t, 1, "w") for d, t in ROWS], "doc_id long, text string, n int, word string")
    assert got(spelling.variant_report(docs)) == brute(brute_words(ROWS))
    assert spelling.variant_report(docs.limit(0)).count() == 0


def test_noise_is_the_contracts(spark):
    rows = [(i, " ".join(f"{a}{b}Word" for a in "abcdefg" for b in "xyzé")) for i in range(60)]
    got = collections.Counter(r.word for r in spelling.noisy_words(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert {w: n for w, n in got.items() if len(w) >= 5 and n >= 3} == brute_words(rows)
