"""Encoding, packing and record files."""

import collections
import zlib

import numpy as np
import pytest

from actiontrail.llm import packing, records
from actiontrail.llm.crc import crc32c, masked, unmasked
from actiontrail.llm.tokens import default_tokenizer, encoder

ODD = ["", " ", "\x1c a\x1db", "It's a ’s ΑΣ Σ. É. é, x.y,,. a<|endoftext|>b  <|startoftext|> c", " x y\u0085z", "'S 'll I'LLs 123,456.7 日本。語",
       ".,́,á.", "İstanbul. ſt K", "WORD!! a*** b### \n\n c,d. e-f", "tab\tfeed\x0cline\rend"]
ROWS = [(i, t) for i, t in enumerate(ODD)] + [(50, None), (None, "no id"), (None, None), (51, "long " * 9000), (51, "other text"), (7, ODD[7]), (7, ODD[7])]


def plain_ids(text, end):
    return np.asarray(encoder(default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", 3, "seq") for d, t in rows], "doc_id long, text string, lang string, piece int, sequence_id string")


def test_encoder_is_exact():
    coder = encoder(default_tokenizer())
    got = coder.encode([*ODD, None])
    assert got == [plain_ids(t, 0)[:-1].tobytes() for t in [*ODD, None]]
    assert coder.encode(ODD) == got[:-1]  # from what is known by now


def test_plan_places_everything():
    rng = np.random.default_rng(5)
    counts = collections.Counter(rng.integers(1, 101, 5000).tolist())
    slots, used = packing.plan(counts, 100)
    filled = collections.defaultdict(list)
    seen = collections.Counter()
    for length, first, last, sequence, each, base in slots:
        for rank in range(first, last):
            seen[length] += 1
            filled[sequence + (rank - first) // each].append((base + (rank - first) % each * length, length))
    assert seen == counts and set(filled) == set(range(used))
    for parts in filled.values():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][0] + parts[-1][1] <= 100
        assert all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:]))
    # Best-fit decreasing, one by one.
    rooms = []
    for length in sorted(counts.elements(), reverse=True):
        fit = min((r for r in rooms if r >= length), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((100 if fit is None else fit) - length)
    assert used == len(rooms)
    assert packing.plan({}, 100) == ([], 0)


def test_packing(spark):
    got = packing.pack_documents(table(spark, ROWS)).collect()
    want = sorted((d is None, d or 0, len(plain_ids(t, 1))) for d, t in ROWS)
    sizes = collections.Counter()
    for r in got:
        sizes[r.doc_id, r.start == 0] += r.length
    assert sum(r.length for r in got) == sum(n for _, _, n in want)
    texts = collections.defaultdict(list)
    for d, t in ROWS:
        texts[d].append(plain_ids(t, 1))
    by = collections.defaultdict(list)
    for r in got:
        assert any(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for ids in texts[r.doc_id])
        assert r.start == r.piece * 4096
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][0] + parts[-1][1] <= 4096
        assert all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:]))
    assert packing.pack_documents(table(spark, [])).count() == 0


def test_sequences_hold_the_ids(spark):
    cut = packing.pieces(table(spark, ROWS[:6])).cache()
    out = packing.sequences(packing.pack(cut)).collect()
    assert sum(r.length for r in out) == sum(len(plain_ids(t, 1)) for _, t in ROWS[:6])
    assert all(len(r.ids) == 4 * r.length for r in out)


def test_checksums():
    assert crc32c(b"123456789") == 0xE3069283 and crc32c(b"") == 0
    data = bytes(np.random.default_rng(1).integers(0, 256, 5000, np.uint8))
    assert crc32c(data) == _slow(data)
    assert unmasked(masked(0x12345678)) == 0x12345678
    damaged = bytearray(records.frame(b"payload"))
    damaged[14] ^= 1
    with pytest.raises(ValueError):
        records.unframe(bytes(damaged), 0)


def _slow(data):
    state = 0xFFFFFFFF
    for byte in data:
        state ^= byte
        for _ in range(8):
            state = (state >> 1) ^ (0x82F63B78 if state & 1 else 0)
    return state ^ 0xFFFFFFFF


def test_record_files(spark):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in records.round_trip(table(spark, ROWS)).collect())
    start, want = 0, []
    for d, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = plain_ids(t, 2)
        want.append((start, d, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want, key=lambda r: r[0])
    assert records.round_trip(table(spark, [])).count() == 0


def test_fetch_by_index(spark):
    manifest = records.write(table(spark, [(i, f"text number {i}") for i in range(30)]), file_bytes=400)
    assert manifest.count() > 3
    for row in manifest.collect():
        read = records.fetch(row.path, list(range(row.n_docs))[::-1])
        assert sum(len(ids) for _, ids in read) == row.n_tokens
        for doc, ids in read:
            assert ids.tobytes() == plain_ids(f"text number {doc}", 2).tobytes()
