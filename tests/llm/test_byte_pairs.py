"""Byte-level BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest

from actiontrail.llm import bpe

ODD = ["", " ", "  a  b\n\n c\t\td ", "I'll we've It'S 'x' don''t", "1234567 ½ Ⅷ 12a", "日本語 テキスト、한국어 ", "ab<|endoftext|>cd <|endoftext|><|endoftext|>x", "<|endoftext|>",
       "<|endoftex", "İ ſ É é   x y\x1c\x1d z\x85", "՘a \U0003fc3fb ꟎ c\U0001f600👩‍👩‍👧", "\x00\x01\x7f", "a" * 5000, "ab" * 3000 + " " * 3000 + "c",
       "x" + "\n" * 700 + "é" * 900]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def strings(seed, many):
    rng = random.Random(seed)
    alphabets = ["abcdefgh 'stre", "aé ßñ1 2.,!\n\t", "日本x ½", "<|endoftext|> ab", "".join(map(chr, range(0x20, 0x250)))]
    return ["".join(rng.choices(rng.choice(alphabets), k=rng.randrange(1, 80))) for _ in range(many)]


def test_ids_and_texts_are_the_librarys():
    coder, plain = bpe.byte_pairs(bpe.default_tokenizer()), library()
    for text in ODD + strings(1, 3000):
        want = plain.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == want, text
        assert coder.decode(np.asarray(want, np.int64), np.asarray([0, len(want)])) == [plain.decode(want, skip_special_tokens=False)]


def test_any_ids_decode():
    coder, plain, rng = bpe.byte_pairs(bpe.default_tokenizer()), library(), random.Random(2)
    for _ in range(300):
        ids = [rng.randrange(60_000) if rng.random() < 0.1 else rng.randrange(50_257) for _ in range(rng.randrange(20))]
        assert coder.decode(np.asarray(ids, np.int64), np.asarray([0, len(ids)])) == [plain.decode(ids, skip_special_tokens=False)]


def test_stale_entries_and_memory_do_not_change_ids(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 7)
    coder, plain = bpe.BytePairs(bpe.default_tokenizer()), library()
    for text in strings(3, 200):
        assert coder.encode(text) == plain.encode(text, add_special_tokens=False).ids
    assert len(coder.new) <= 7 and len(coder.old) <= 7


def test_other_kinds_of_files_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.BytePairs(public_tokenizers.path("word_bpe_49k.json"))


ROWS = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (3, ODD[3]), (None, "no id"), (None, None), (40, None), (41, "long text " * 30_000)]
EXTRA = "doc_id long, text string, ids string, decoded int, _read string, `a b.c` int"


def test_report(spark):
    docs = spark.createDataFrame([(d, t, "i", 1, "r", 2) for d, t in ROWS], EXTRA)
    got = sorted(map(tuple, bpe.coding_report(docs).collect()), key=str)
    plain = library()
    want = []
    for doc, text in ROWS:
        ids = plain.encode(text or "", add_special_tokens=False).ids
        back = plain.decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.coding_report(docs.limit(0)).count() == 0


def test_encode_and_decode_keep_other_columns(spark):
    docs = spark.createDataFrame([(d, t, "i", 1, "r", 2) for d, t in ROWS], EXTRA)
    coded = bpe.encode(docs)
    assert set(coded.columns) == set(docs.columns)
    both = bpe.decode(coded, to="IDS_text").collect()
    assert [(r.doc_id, r.text, r["a b.c"], r._read, r.IDS_text) for r in both] == [(d, t, 2, "r", t or "") for d, t in ROWS]
    odd = spark.createDataFrame([(None,), ([],), ([15496, None, -5, 10**8, 995],)], "ids array<long>")
    assert [r.decoded for r in bpe.decode(odd.withColumn("ids", odd.ids.cast("array<int>"))).collect()] == ["", "", "Hello world"]
