"""Cross-tokenizer alignment and pair counts against plain dictionaries."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from actiontrail.llm import token_align
from actiontrail.llm.perfect_hash import PerfectHash

ODD = ["", " ", "  a  b\n\n c", "It's <|endoftext|> and <s> x</s>", "日本語 é ½ \U0001f600", "a ▁ b", "▁", "\x00 a\tb\r\n", "x" * 3000, "naïve café", "the cat sat", " the cat sat "]
ROWS = [(i, t) for i, t in enumerate(ODD)] + [(10, ODD[10]), (10, ODD[10]), (None, "no id"), (None, None), (50, None), (51, "the cat sat. " * 9000)]


def random_rows(seed, many):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé st", k=rng.randrange(1, 9))) for _ in range(60)]
    return [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(many)]


def brute(rows):
    own = token_align.aligner(*token_align.default_tokenizers())
    letters = token_align.byte_letters()
    texts, counts = [], collections.Counter()
    for doc, text in rows:
        spaced = (" " + text).encode() if text else b""
        a = [(i, b"<|endoftext|>" if (s := own.left.id_to_token(i)) == "<|endoftext|>" else bytes(letters[c] for c in s)) for i in
             (own.left.encode(" " + text, add_special_tokens=False).ids if text else [])]
        b = []
        for i in own.right.encode(text) if text else []:
            piece = own.right.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if own.right.is_byte(i) else piece.replace("▁", " ").encode()))
        if b"".join(s for _, s in a) != spaced or b"".join(s for _, s in b) != spaced:
            a = b = []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, s in side:
                out.append((i, at, at + len(s)))
                at += len(s)
            spans.append(out)
        links, k = [], 0
        for i, s, e in spans[0]:
            while k and spans[1][k - 1][2] > s:
                k -= 1
            while k < len(spans[1]) and spans[1][k][1] < e:
                if spans[1][k][2] > s:
                    links.append((i, spans[1][k][0]))
                k += 1
        counts.update(links)
        common = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, begin = [], 0
        for end in common:
            groups.append("|".join(",".join(str(i) for i, s, e in side if begin <= s and e <= end) for side in spans) if len(common) < 2000 else None)
            begin = end
        texts.append((doc, len(a), len(b), len(common), links, groups))
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc, n_a, n_b, n_groups, links, groups in texts:
        digest = "" if not groups else None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc, n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out, counts


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 5, "g", 1) for d, t in rows], "doc_id long, text string, n_a int, bucket string, a_ids int")


@pytest.mark.parametrize("rows", [ROWS, random_rows(4, 300)])
def test_report(spark, rows):
    want, _ = brute(rows)
    got = [tuple(r) for r in token_align.alignment_report(frame(spark, rows)).collect()]
    assert len(got) == len(want)
    for x, y in zip(sorted(got, key=str), sorted(want, key=str)):
        assert x[:7] == y[:7] and (y[7] is None or x[7] == y[7])


def test_a_report_aligns_each_text_once(spark):
    """The second pass reads the links that the first one kept."""
    seen = spark.sparkContext.accumulator(0)
    own = F.udf(lambda text: (seen.add(1), text)[1], "string").asNondeterministic()
    rows = random_rows(5, 40)
    out = token_align.alignment_report(frame(spark, rows).withColumn("text", own("text")))
    assert len(out.collect()) == 40 and seen.value == 40


def test_counts_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(token_align, "HELD_PAIRS", 50)
    rows = random_rows(6, 200)
    counts = brute(rows)[1]
    manifest = token_align.pair_index(frame(spark, rows).repartition(5))
    got = {(r.a_id, r.b_id): r.n for r in token_align.pair_counts(manifest).collect()}
    assert got == dict(counts)


def test_buckets_are_read_again(spark, monkeypatch):
    monkeypatch.setattr(token_align, "HELD_BYTES", 1)
    rows = random_rows(7, 50)
    counts = brute(rows)[1]
    files = {r.bucket: r.path for r in token_align.pair_index(frame(spark, rows)).collect()}
    index, many = token_align.PairIndex(files), token_align.aligner(*token_align.default_tokenizers()).b_many
    keys = np.asarray([a * many + b for a, b in counts], np.uint64)
    for _ in range(2):
        assert index.counts(keys).tolist() == list(counts.values()) and len(index.held) == 1


def test_learnt_words_do_not_change_ids(monkeypatch):
    """Whole texts through the libraries, against words learnt, forgotten and learnt again."""
    rng = random.Random(9)
    plain = [t for _, t in random_rows(8, 150)] + [t for t in ODD if t] + ["".join(rng.choices("ab é'\n\t.1  \x1c\u3000", k=60)) for _ in range(300)]
    whole = token_align.Aligner(*token_align.default_tokenizers())
    words, whole.known = whole.known, None
    want = whole._encoded(plain)
    for known in (10**6, 40):
        monkeypatch.setattr(token_align, "KNOWN_WORDS", known)
        for at in range(0, len(plain), 20):
            for k, (ids, cuts) in enumerate(words.encode(plain[at:at + 20])):
                all_ids, all_cuts = want[k]
                assert ids.tolist() == all_ids[all_cuts[at]:all_cuts[min(at + 20, len(plain))]].tolist()
                assert (cuts == all_cuts[at:at + 21] - all_cuts[at]).all()


def test_align_keeps_other_columns(spark):
    rows = token_align.align(frame(spark, ROWS[:12])).collect()
    assert [(r.doc_id, r.text, r.bucket) for r in rows] == [(d, t, "g") for d, t in ROWS[:12]]
    for r in rows:
        assert sum(r.a_in_group) == len(r.a_ids) and sum(r.b_in_group) == len(r.b_ids) and len(r.a_in_group) == len(r.b_in_group)
    assert rows[5].a_ids == rows[6].a_ids == [] and rows[10].a_ids


def test_empty_table(spark):
    assert token_align.alignment_report(frame(spark, ROWS).limit(0)).count() == 0
    assert token_align.alignment_report(frame(spark, [(1, None)])).collect()[0].groups_sha256 == ""


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for many in (0, 1, 2, 63, 64, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, many).astype(np.uint64))
        hashed = PerfectHash.build(keys)
        again = PerfectHash.from_bytes(hashed.to_bytes())
        assert sorted(hashed.index(keys).tolist()) == list(range(len(keys))) and (again.index(keys) == hashed.index(keys)).all()
    assert len(hashed.to_bytes()) * 8 < 5 * len(keys)
    with pytest.raises(ValueError):
        PerfectHash.build(np.asarray([7, 7], np.uint64))
    bucket = token_align.Bucket(hashed.to_bytes(), token_align._narrow(_ordered(hashed, keys)), np.zeros(len(keys)))
    with pytest.raises(KeyError):
        bucket.numbers(np.asarray([12345], np.uint64))


def _ordered(hashed, keys):
    out = np.empty_like(keys)
    out[hashed.index(keys)] = keys
    return out
