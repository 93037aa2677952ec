"""Alignment of two tokenizers' tokens over the same bytes, and how often each pair of token ids meets in a corpus.

A tokenizes a space and the text, B the text, to which it adds the space itself. Tokens are byte ranges; where ranges of both end together a
group ends. A link is a pair of tokens whose ranges overlap: one for each stretch between two neighbouring ends.

Pair counts: a first pass over the texts sums links by pair of ids inside each task. The distinct pairs are dealt to BUCKETS by
hash and united in two steps; each bucket builds a minimal perfect hash over its pairs and keeps the pairs in the order of their
numbers. Partial counts then become dense vectors indexed by that hash, summed in a tree: first for a part of the tasks, then for
the whole bucket. A bucket's hash, pairs and counts are one file below the shared folder; only committed manifest rows name files. The
first pass of a report also keeps each document's links by pair in the shared folder (four bytes a link, about a token of text); the second
pass reads those and looks counts up; a looked-up pair is compared with the pair stored at its number.

Sizes: a bucket holds at most |A| * |B| / BUCKETS pairs, whatever the corpus (6.3 million here). A worker keeps HELD_BYTES of
buckets and reads others again. The driver sees one row for each bucket and, for the best partner of each id of B, at most |B| numbers.

Texts that are null, empty, or whose tokens do not spell a space and the text (U+2581 in a text does that) have no tokens: zeros,
and the empty string for the groups. A worker learns words between single spaces once (KNOWN_WORDS at a time) where neither
tokenizer can reach over such a border; other pairs of tokenizers get whole texts. Special tokens' strings are plain text. Repeated rows, ties and null doc_ids are rows like any other;
extra columns are ignored by the reports and kept by `align`. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
import struct
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actiontrail.llm.bpe import byte_letters
from actiontrail.llm.perfect_hash import PerfectHash
from actiontrail.llm.shared import attempt_name, get, put, quoted, saved, scratch, ship, spread_count
from actiontrail.llm.text_bytes import mixed, parts, running, texts

BUCKETS = 256
FAN = 8
HELD_PAIRS = 1_000_000
HELD_BYTES = 96 << 20
KNOWN_WORDS = 500_000
KNOWN_TOKENS = 8_000_000


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Tokens:
    """Tokens of a slice of texts: ids, the byte at which each ends, and where each text's tokens begin (n + 1 numbers)."""

    ids: np.ndarray
    ends: np.ndarray
    cuts: np.ndarray


@dataclass
class Aligned:
    """Of a slice: tokens of both sides of the texts that have any (others have none), and one entry for each link."""

    a: Tokens
    b: Tokens
    a_at: np.ndarray
    b_at: np.ndarray
    closes: np.ndarray
    link_cuts: np.ndarray


class _Side:
    """Bytes of each id."""

    def __init__(self, strings: list[bytes]):
        self.first = running(np.fromiter(map(len, strings), np.int64, len(strings)))
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.first[ids + 1] - self.first[ids]

    def spell(self, ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        places = np.repeat(self.first[ids] - ends + sizes, sizes)
        return self.bytes[places + np.arange(len(places))]


class Words:
    """Ids on both sides of pieces of text between single spaces, learnt once and kept by number.

    Neither tokenizer has a token that reaches over the border before a space that stands between two other
    letters: A's pre-tokens end there, and no piece of B holds its space mark behind another letter.
    """

    CUT = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, left, right, sides):
        self.left, self.right, self.sides = left, right, sides
        self.number: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.first = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.used = np.zeros(0, np.int64)

    def _joined(self, group: list[str], ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Both sides' ids of words that are encoded as one text, and where each word's begin; None where borders do not meet."""
        text = " ".join(group)
        out = []
        for side, ids in zip(self.sides, (self.left.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids, self.right.encode(text))):
            ids = np.asarray(ids, np.int64)
            bytes_to = np.cumsum(side.sizes(ids))
            cuts = np.searchsorted(bytes_to, ends)
            if cuts[-1] != len(ids) - 1 or (bytes_to[np.minimum(cuts, len(ids) - 1)] != ends).any():
                return None
            out.append((ids, cuts + 1))
        return out

    def _learn(self, fresh: list[str]) -> None:
        fresh = [w for w in fresh if "▁" not in w] + [w for w in fresh if "▁" in w]
        sizes = np.fromiter((len(w) + 1 if w.isascii() else len(w.encode()) + 1 for w in fresh), np.int64, len(fresh))
        parts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        at = 0
        while at < len(fresh):
            group = fresh[at:at + (1 if "▁" in fresh[at] else 2000)]
            found = self._joined(group, np.cumsum(sizes[at:at + len(group)])) if "▁" not in group[-1] else None
            if found is None:
                found = []
                for lists in ([self.left.encode(f" {w}", add_special_tokens=False).ids for w in group], [self.right.encode(w) for w in group]):
                    found.append((np.asarray(list(itertools.chain.from_iterable(lists)), np.int64), np.cumsum([len(x) for x in lists])))
            parts.append(found)
            at += len(group)
        for side in (0, 1):
            ids, firsts = [self.ids[side]], [self.first[side]]
            end = self.first[side][-1]
            for found in parts:
                ids.append(found[side][0])
                firsts.append(found[side][1] + end)
                end = firsts[-1][-1]
            self.ids[side], self.first[side] = np.concatenate(ids), np.concatenate(firsts)
        self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh))))
        self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int64)])

    def _take(self, side: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.first[side]
        begins, sizes = first[numbers], first[numbers + 1] - first[numbers]
        at = running(sizes)
        return self.ids[side][np.repeat(begins - at[:-1], sizes) + np.arange(at[-1])], at

    def _shrink(self) -> None:
        """Keep the words that were met more than once since the last time, half of the room at most."""
        keep = np.flatnonzero(self.used > 1)
        keep = np.sort(keep[np.argsort(-self.used[keep], kind="stable")][:KNOWN_WORDS // 2])
        keep = keep[np.cumsum(np.diff(self.first[0])[keep]) <= KNOWN_TOKENS // 2]
        names = list(self.number)
        for side in (0, 1):
            ids, at = self._take(side, keep)
            self.ids[side], self.first[side] = ids, at
        self.number = {names[k]: at for at, k in enumerate(keep.tolist())}
        self.used = np.zeros(len(keep), np.int64)

    def encode(self, plain: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both sides: ids of all texts and where each text's begin."""
        if len(self.number) > KNOWN_WORDS or len(self.ids[0]) > KNOWN_TOKENS:
            self._shrink()
        words = [self.CUT.split(text) if text else [] for text in plain]
        cuts = running(np.fromiter(map(len, words), np.int64, len(words)))
        every = list(itertools.chain.from_iterable(words))
        fresh = list(set(every).difference(self.number))
        if fresh:
            self._learn(fresh)
        numbers = np.fromiter(map(self.number.__getitem__, every), np.int64, len(every))
        self.used += np.bincount(numbers, minlength=len(self.used))
        out = []
        for side in (0, 1):
            ids, at = self._take(side, numbers)
            out.append((ids, at[cuts]))
        return out


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        # Tasks share the cores already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.left = Tokenizer.from_file(path_a)
        self.left.encode_special_tokens = True
        self.right = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as file:
            spec = json.load(file)
        letters, strings = byte_letters(), {}
        for token, i in spec["model"]["vocab"].items():
            strings[i] = bytes(letters[c] for c in token)
        for token in spec["added_tokens"]:
            strings.setdefault(token["id"], token["content"].encode())
        self.a_side = _Side([strings.get(i, b"") for i in range(max(strings) + 1)])
        many, right = self.right.get_piece_size(), self.right
        self.b_side = _Side([bytes([int(right.id_to_piece(i)[3:-1], 16)]) if right.is_byte(i)
                             else right.id_to_piece(i).replace("▁", " ").encode() for i in range(many)])
        self.a_many, self.b_many = len(self.a_side.first) - 1, many
        self.narrow = np.uint32 if self.a_many * self.b_many < 1 << 32 else np.uint64
        self.words: list[str] | None = None
        cut = spec["pre_tokenizer"] or {}
        separable = (cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not spec["normalizer"]
                     and not any("▁" in right.id_to_piece(i).lstrip("▁") for i in range(many)))
        self.known = Words(self.left, right, (self.a_side, self.b_side)) if separable else None

    def _encoded(self, plain: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        if self.known is not None:
            return self.known.encode(plain)
        left = [e.ids if t else [] for e, t in zip(self.left.encode_batch_fast([f" {t}" for t in plain], add_special_tokens=False), plain)]
        out = []
        for lists in (left, self.right.encode(plain, num_threads=1)):
            cuts = running(np.fromiter(map(len, lists), np.int64, len(lists)))
            out.append((np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(cuts[-1])), cuts))
        return out

    def _good(self, tokens: Tokens, sizes: np.ndarray, side: _Side, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which texts the tokens spell."""
        total = running(sizes)[tokens.cuts]
        same = np.diff(total) == np.diff(bounds)
        spelt = side.spell(tokens.ids, sizes, tokens.ends)
        if same.all():
            wrong = np.flatnonzero(spelt != data)
            same[np.searchsorted(bounds, wrong, "right") - 1] = False
        else:
            for k in np.flatnonzero(same):
                same[k] = np.array_equal(spelt[total[k]:total[k + 1]], data[bounds[k]:bounds[k + 1]])
        return same

    def align(self, column: pa.Array) -> Aligned:
        """Tokens and links of every text of a slice."""
        plain = [text or "" for text in column.to_pylist()]
        data, bounds = texts(pa.array([f" {text}" if text else "" for text in plain], pa.large_string()))
        good, sides = np.diff(bounds) > 0, []
        for (ids, cuts), side in zip(self._encoded(plain), (self.a_side, self.b_side)):
            sizes = side.sizes(ids)
            tokens = Tokens(ids, np.cumsum(sizes), cuts)
            good &= self._good(tokens, sizes, side, data, bounds)
            sides.append(tokens)
        if not good[np.diff(bounds) > 0].all():
            for k, side in enumerate((self.a_side, self.b_side)):
                counts = np.diff(sides[k].cuts)
                ids = sides[k].ids[np.repeat(good, counts)]
                sides[k] = Tokens(ids, np.cumsum(side.sizes(ids)), running(counts * good))
        a, b = sides
        size = int(a.ends[-1]) if len(a.ends) else 0
        in_a, in_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        in_a[a.ends], in_b[b.ends] = True, True
        ends = np.flatnonzero(in_a | in_b)
        own_a, own_b = in_a[ends], in_b[ends]
        a_at, b_at = np.cumsum(own_a) - own_a, np.cumsum(own_b) - own_b
        return Aligned(a, b, a_at, b_at, own_a & own_b, np.searchsorted(a_at, a.cuts))

    def keys(self, x: Aligned) -> np.ndarray:
        """One number for each link's pair of ids."""
        return (x.a.ids[x.a_at] * self.b_many + x.b.ids[x.b_at]).astype(np.uint64)

    def links(self, x: Aligned) -> np.ndarray:
        """`keys` in the narrower of four or eight bytes."""
        return self.keys(x).astype(self.narrow)

    def group_sizes(self, x: Aligned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of A and of B in each group, and where each text's groups begin."""
        last = np.flatnonzero(x.closes)
        a_ends, b_ends = x.a_at[last] + 1, x.b_at[last] + 1
        return np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0), running(x.closes)[x.link_cuts]

    def group_texts(self, x: Aligned) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` for each text."""
        if self.words is None:
            self.words = [f"{i}{mark}" for many, marks in ((self.a_many, ",|"), (self.b_many, ",;")) for mark in marks for i in range(many)]
        n_a, n_b, cuts = self.group_sizes(x)
        last = np.flatnonzero(x.closes)
        a_ends, b_ends = x.a_at[last] + 1, x.b_at[last] + 1
        a_word, b_word = x.a.ids.copy(), x.b.ids + 2 * self.a_many
        a_word[a_ends - 1] += self.a_many
        b_word[b_ends - 1] += self.b_many
        order = np.empty(len(a_word) + len(b_word), np.int64)
        order[np.arange(len(a_word)) + np.repeat(b_ends - n_b, n_a)] = a_word
        order[np.arange(len(b_word)) + np.repeat(a_ends, n_b)] = b_word
        tokens, words = (x.a.cuts + x.b.cuts).tolist(), self.words
        flat = order.tolist()
        return ["".join([words[i] for i in flat[s:e]])[:-1] for s, e in zip(tokens, tokens[1:])]


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _batch(schema: T.StructType | list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=schema)


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int32)))


ALIGNED = ["a_ids", "b_ids", "a_in_group", "b_in_group"]


def align(docs: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """Adds a_ids and b_ids, and for each group how many ids of either side it has: a_in_group, b_in_group (arrays of int)."""
    ship(docs.sparkSession)
    paths = tokenizers or default_tokenizers()
    kept = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in ALIGNED])
    source, ints = [c.lower() for c in kept.columns].index("text"), T.ArrayType(T.IntegerType())
    schema = T.StructType(kept.schema.fields + [T.StructField(n, ints) for n in ALIGNED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*paths)
        for part in parts(batches, source):
            x = own.align(part.column(source))
            n_a, n_b, cuts = own.group_sizes(x)
            yield _batch(schema.names, *part.columns, _lists(x.a.ids, x.a.cuts), _lists(x.b.ids, x.b.cuts), _lists(n_a, cuts), _lists(n_b, cuts))

    return kept.toDF(*[f"c{k}" for k in range(len(kept.columns))]).mapInArrow(run, schema)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _narrow(keys: np.ndarray) -> bytes:
    """Keys as the narrower of four or eight bytes, named by the first byte."""
    kind = "<u4" if not len(keys) or int(keys.max()) < 1 << 32 else "<u8"
    return kind[-1].encode() + keys.astype(kind).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[:1].decode()}", offset=1).astype(np.uint64)


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(40)).astype(np.int64) % BUCKETS


PARTIAL = "bucket int, fan int, keys binary, counts binary"
DONE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


class Partials:
    """Links of one task summed by pair; rows of PARTIAL come out when many are held, and at the end."""

    def __init__(self):
        from pyspark import TaskContext

        self.fan = TaskContext.get().partitionId() % FAN
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.fresh = 0

    def add(self, links: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(links, return_counts=True)
        self.held.append((keys.astype(np.uint64), counts))
        self.fresh += len(keys)
        if self.fresh >= HELD_PAIRS:
            self.held[:] = [_summed(*map(np.concatenate, zip(*self.held)))]
            self.fresh = 0
            if len(self.held[0][0]) >= HELD_PAIRS:
                yield self._flush()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.held[:] = [_summed(*map(np.concatenate, zip(*self.held)))]
            yield self._flush()

    def _flush(self) -> pa.RecordBatch:
        keys, counts = self.held[0]
        bucket = _bucket(keys)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        used = [k for k in range(BUCKETS) if ends[k] < ends[k + 1]]
        cut = [order[ends[k]:ends[k + 1]] for k in used]
        self.held.clear()
        return _batch(["bucket", "fan", "keys", "counts"], pa.array(used, pa.int32()), pa.array([self.fan] * len(used), pa.int32()),
                      pa.array([_narrow(keys[c]) for c in cut], pa.binary()), pa.array([_narrow(counts[c]) for c in cut], pa.binary()))


def partial_counts(docs: DataFrame, tokenizers: tuple[str, str]) -> DataFrame:
    """The links of each task by pair, cut into buckets; saved."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = aligner(*tokenizers), Partials()
        for part in parts(batches, 0):
            yield from held.add(own.links(own.align(part.column(0))))
        yield from held.rest()

    return saved(docs.select("text").mapInArrow(run, PARTIAL), "pair-partials")


def _padded(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """The batch with nulls in the columns that it lacks."""
    names = set(batch.schema.names)
    return pa.RecordBatch.from_arrays([batch.column(f.name) if f.name in names else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema)


def aligned_once(docs: DataFrame, tokenizers: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """First pass of a report: (partial counts, each document's tokens, groups and links by pair); saved together."""
    both = pa.schema([("bucket", pa.int32()), ("fan", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("doc_id", pa.int64()),
                      *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("links", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = aligner(*tokenizers), Partials()
        for part in parts(batches, 1):
            x = own.align(part.column(1))
            links, cut = own.links(x), x.link_cuts
            for out in held.add(links):
                yield _padded(out, both)
            data, ends = links.tobytes(), (cut * links.itemsize).tolist()
            digests = [hashlib.sha256(text.encode()).hexdigest() if text else "" for text in own.group_texts(x)]
            yield _padded(_batch(
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"], part.column(0), pa.array(np.diff(x.a.cuts)),
                pa.array(np.diff(x.b.cuts)), pa.array(np.diff(running(x.closes)[cut])), pa.array(np.diff(cut)), pa.array(digests, pa.string()),
                pa.array([data[s:e] for s, e in zip(ends, ends[1:])], pa.binary())), both)
        for out in held.rest():
            yield _padded(out, both)

    rows = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"{PARTIAL}, {DONE}"), "aligned")
    return (rows.where("bucket IS NOT NULL").select("bucket", "fan", "keys", "counts"),
            rows.where("bucket IS NULL").drop("bucket", "fan", "keys", "counts"))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows that are sorted by bucket, one bucket at a time."""
    rows = (row for batch in batches for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist())
    yield from itertools.groupby(rows, key=lambda row: row["bucket"])


def _united(rows: Iterator[dict]) -> np.ndarray:
    """Distinct keys of many rows, holding about twice the result at most."""
    held, fresh = np.zeros(0, np.uint64), []
    for row in rows:
        fresh.append(_wide(row["keys"]))
        if sum(map(len, fresh)) > max(len(held), 100_000):
            held, fresh = np.unique(np.concatenate([held, *fresh])), []
    return np.unique(np.concatenate([held, *fresh]))


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    return rows.repartition(spread_count(rows), *by).sortWithinPartitions(*by)


def pair_hashes(partials: DataFrame) -> DataFrame:
    """(bucket, hash, keys): each bucket's perfect hash and its pairs in the order of their numbers; saved."""
    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            yield _batch(["bucket", "keys"], pa.array([bucket], pa.int32()), pa.array([_narrow(_united(rows))], pa.binary()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            keys = _united(rows)
            hashed = PerfectHash.build(keys)
            ordered = np.empty_like(keys)
            ordered[hashed.index(keys)] = keys
            yield _batch(["bucket", "hash", "keys"], pa.array([bucket], pa.int32()), pa.array([hashed.to_bytes()], pa.binary()),
                         pa.array([_narrow(ordered)], pa.binary()))

    first = _dealt(partials.select("bucket", "fan", "keys"), "bucket", "fan").drop("fan").mapInArrow(unite, "bucket int, keys binary")
    return saved(_dealt(first, "bucket").mapInArrow(build, "bucket int, hash binary, keys binary"), "pair-hashes")


class Bucket:
    """One bucket of the index: perfect hash, pairs and counts."""

    def __init__(self, hashed: bytes, keys: bytes, counts: np.ndarray):
        self.hash, self.keys, self.counts = PerfectHash.from_bytes(hashed), keys, counts
        self.stored = np.frombuffer(keys, f"<u{keys[:1].decode()}", offset=1)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; raises where a key is not the one stored there."""
        at = self.hash.index(keys)
        if len(at) and (int(at.min()) < 0 or (self.stored[at] != keys).any()):
            raise KeyError("a pair that the index does not hold")
        return at

    def to_bytes(self) -> bytes:
        hashed, counts = self.hash.to_bytes(), _narrow(self.counts.astype(np.uint64))
        return struct.pack("<3Q", len(hashed), len(self.keys), len(counts)) + hashed + self.keys + counts

    @classmethod
    def from_bytes(cls, data: bytes) -> Bucket:
        n_hash, n_keys, n_counts = struct.unpack_from("<3Q", data)
        at = 24 + n_hash + n_keys
        counts = data[at:at + n_counts]
        return cls(data[24:24 + n_hash], data[24 + n_hash:at], np.frombuffer(counts, f"<u{counts[:1].decode()}", offset=1))

    @property
    def size(self) -> int:
        return self.hash.words.nbytes * 2 + self.stored.nbytes + self.counts.nbytes


def dense_counts(partials: DataFrame, hashes: DataFrame) -> DataFrame:
    """(bucket, path): one file for each bucket with its hash, pairs and summed counts; saved."""
    spark = partials.sparkSession
    folder = scratch(spark, "pair-index")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            lead = next(rows)
            own = Bucket(lead["hash"], lead["keys"], np.zeros(0))
            total = np.zeros(own.hash.count, np.int64)
            for row in rows:
                total[own.numbers(_wide(row["keys"]))] += _wide(row["counts"]).astype(np.int64)
            yield _batch(["bucket", "counts"], pa.array([bucket], pa.int32()), pa.array([_narrow(total.astype(np.uint64))], pa.binary()))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_bucket(batches):
            lead = next(rows)
            total = np.zeros(PerfectHash.from_bytes(lead["hash"]).count, np.int64)
            for row in rows:
                total += _wide(row["counts"]).astype(np.int64)
            path = f"{folder}/{attempt_name()}-{bucket}.pairs"
            put(path, Bucket(lead["hash"], lead["keys"], total).to_bytes())
            yield _batch(["bucket", "path"], pa.array([bucket], pa.int32()), pa.array([path]))

    none = F.lit(None).cast("binary")
    # A bucket's hash comes before its counts; parts of the tasks that have none cost a row.
    leads = hashes.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(FAN - 1))).alias("fan"), F.lit(0).alias("kind"), "hash", "keys", none.alias("counts"))
    counted = partials.select("bucket", "fan", F.lit(1).alias("kind"), none.alias("hash"), "keys", "counts")
    by = ["bucket", "fan", "kind"]
    both = leads.union(counted).repartition(spread_count(partials), "bucket", "fan").sortWithinPartitions(*by)
    sums = both.mapInArrow(add_by_fan(add), "bucket int, counts binary")
    both = (hashes.select("bucket", F.lit(0).alias("kind"), "hash", "keys", none.alias("counts"))
            .union(sums.select("bucket", F.lit(1), none, none, "counts")))
    done = both.repartition(spread_count(partials), "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(finish, "bucket int, path string")
    return saved(done, "pair-manifest")


def add_by_fan(add):
    """`add` over rows sorted by (bucket, fan): each (bucket, fan) by itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def renumbered() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = np.asarray(batch.column("bucket")).astype(np.int64) * FAN + np.asarray(batch.column("fan"))
                yield batch.set_column(0, "bucket", pa.array(both))
        for out in add(renumbered()):
            bucket = np.asarray(out.column("bucket")) // FAN
            yield out.set_column(0, "bucket", pa.array(bucket.astype(np.int32)))
    return run


class PairIndex:
    """Counts of all pairs by the files of a manifest; keeps HELD_BYTES of buckets, the last used ones."""

    def __init__(self, paths: dict[int, str]):
        self.paths, self.held, self.bytes = paths, OrderedDict(), 0

    def bucket(self, number: int) -> Bucket:
        found = self.held.pop(number, None)
        if found is None:
            found = Bucket.from_bytes(get(self.paths[number]))
            self.bytes += found.size
        self.held[number] = found
        while self.bytes > HELD_BYTES and len(self.held) > 1:
            _, gone = self.held.popitem(last=False)
            self.bytes -= gone.size
        return found

    def counts(self, keys: np.ndarray) -> np.ndarray:
        out, bucket = np.empty(len(keys), np.int64), _bucket(keys)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        for number in np.unique(bucket).tolist():
            at = order[ends[number]:ends[number + 1]]
            own = self.bucket(number)
            out[at] = own.counts[own.numbers(keys[at])]
        return out


_INDEXES: dict[str, PairIndex] = {}


def _index(paths: dict[int, str]) -> PairIndex:
    """One index for each worker and corpus."""
    name = min(paths.values(), default="")
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = PairIndex(paths)
    return _INDEXES[name]


def pair_index(docs: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """The manifest (bucket, path) of all pair counts of `docs`."""
    ship(docs.sparkSession)
    partials = partial_counts(docs, tokenizers or default_tokenizers())
    return dense_counts(partials, pair_hashes(partials))


def pair_counts(manifest: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """(a_id, b_id, n) of every pair that occurs."""
    paths = tokenizers or default_tokenizers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = aligner(*paths).b_many
        for batch in batches:
            for path in batch.column("path").to_pylist():
                own = Bucket.from_bytes(get(path))
                for at in range(0, len(own.stored), 100_000):
                    keys = own.stored[at:at + 100_000].astype(np.int64)
                    yield _batch(["a_id", "b_id", "n"], pa.array((keys // many).astype(np.int32)), pa.array((keys % many).astype(np.int32)),
                                 pa.array(own.counts[at:at + 100_000].astype(np.int64)))

    spread = manifest.repartition(spread_count(manifest))
    return spread.mapInArrow(run, "a_id int, b_id int, n long")


REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def alignment_report(docs: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """Of each document: its tokens, groups and links, and what the corpus's pair counts say about its links."""
    spark: SparkSession = docs.sparkSession
    paths = tokenizers or default_tokenizers()
    ship(spark)
    partials, done = aligned_once(docs, paths)
    manifest = dense_counts(partials, pair_hashes(partials))
    files = {r["bucket"]: r["path"] for r in manifest.collect()}
    own = aligner(*paths)
    many, narrow, best = own.b_many, own.narrow, np.zeros(own.b_many, np.int64)
    for row in pair_counts(manifest, paths).groupBy("b_id").agg(F.max("n").alias("n")).collect():
        best[row["b_id"]] = row["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(files)
        for part in parts(batches, 6):
            data, bounds = texts(part.column(6))
            links = np.frombuffer(data.tobytes(), narrow)
            cut = bounds // links.itemsize
            keys, back = np.unique(links, return_inverse=True)
            keys = keys.astype(np.uint64)
            counts = index.counts(keys)
            leads = counts == best[(keys % np.uint64(many)).astype(np.int64)]

            def per_text(values: np.ndarray) -> pa.Array:
                return pa.array(np.diff(running(values)[cut]))

            yield _batch(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                         *part.columns[:5], per_text(leads[back]), per_text(counts[back]), part.column(5))

    return done.mapInArrow(run, REPORT)
