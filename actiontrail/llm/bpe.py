"""Byte-level BPE with a public tokenizer file: encoding by a queue of merge ranks, decoding by the vocabulary's strings.

A text is cut at the file's added tokens, then into pre-tokens. The bytes of a pre-token are a doubly linked list of
symbols; a priority queue holds (rank, place) of every neighbouring pair that has a merge. The least entry is taken; it is stale,
and skipped, if its left symbol is gone or the pair there has another rank by now. A merge relinks two symbols and
queues the two pairs it makes, so a pre-token of n bytes costs n log n whatever its length. A worker remembers pre-tokens
it has merged in two generations of bounded size.

Decoding joins the bytes of the ids' vocabulary strings and reads them as UTF-8; parts that are not UTF-8 become U+FFFD.

Null and empty texts have no ids and decode to the empty text; null ids decode to the empty text; ids that the vocabulary does not have
are skipped. Every row is taken by itself, so repeated rows, null ids of documents and ties change nothing; other
columns are kept, and a column of the name that is added is replaced. Texts are whole, whatever their length.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actiontrail.llm.shared import private, quoted, ship
from actiontrail.llm.text_bytes import parts, running

KNOWN_WORDS = 200_000

# The pre-token pattern of byte-level BPE files.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Scripts whose letters, numbers and white space are the same in every Unicode version in use.
STABLE = "\x00-՗‐-⁤←-⏿─-⟿、-〩ぁ-ゖァ-ヺ一-龥가-힣"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such files: Latin-1 letters for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(0x100 + k): b for k, b in enumerate(rest)}


class BytePairs:
    """Merge ranks and vocabulary of one file; raises ValueError where the file is of another kind."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
                 and not cut["add_prefix_space"] and not spec["normalizer"]
                 and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                                    "byte_fallback", "ignore_merges")))
        if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        letters, vocab = byte_letters(), model["vocab"]
        self.symbol = [0] * 256
        for letter, byte in letters.items():
            self.symbol[byte] = vocab[letter]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[vocab[left], vocab[right]] = len(self.made)
            self.made.append(vocab[left + right])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        strings |= {i: token.encode() for token, i in self.added.items()}
        sizes = np.zeros(max(strings) + 1, np.int64)
        for i, string in strings.items():
            sizes[i] = len(string)
        self.first = running(sizes)
        self.bytes = np.frombuffer(b"".join(strings.get(i, b"") for i in range(len(sizes))), np.uint8)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.pattern, self.unstable = regex.compile(PRE_TOKEN), regex.compile(f"[^{STABLE}]")
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.new: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        rank, made = self.rank, self.made
        ids: list[int] = [self.symbol[b] for b in data]
        many = len(ids)
        after, before = list(range(1, many + 1)), list(range(-1, many - 1))
        queue = [(r, at) for at, pair in enumerate(zip(ids, ids[1:])) if (r := rank.get(pair)) is not None]
        heapq.heapify(queue)
        while queue:
            r, at = heapq.heappop(queue)
            right = after[at]
            # A symbol that was merged into its left neighbour has the id -1, which no pair has.
            if right == many or rank.get((ids[at], ids[right])) != r:
                continue
            ids[at], ids[right] = made[r], -1
            follow = after[at] = after[right]
            if follow < many:
                before[follow] = at
                if (found := rank.get((ids[at], ids[follow]))) is not None:
                    heapq.heappush(queue, (found, at))
            if (lead := before[at]) >= 0 and (found := rank.get((ids[lead], ids[at]))) is not None:
                heapq.heappush(queue, (found, lead))
        return [i for i in ids if i >= 0]

    def pre_tokens(self, text: str) -> list[str]:
        if self.unstable.search(text):
            # The Unicode tables of the pattern library may be newer than the tokenizer's, so its own rule decides.
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def _word(self, word: str) -> list[int]:
        ids = self.old.get(word)
        if ids is None:
            ids = self.merged(word.encode())
        if len(word) <= 64:
            if len(self.new) >= KNOWN_WORDS:
                self.old, self.new = self.new, {}
            self.new[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        for piece in self.marks.split(text) if self.marks else [text]:
            if piece in self.added:
                out.append(self.added[piece])
            elif piece:
                known = self.new
                for word in self.pre_tokens(piece):
                    ids = known.get(word)
                    if ids is None:
                        ids = self._word(word)
                        known = self.new
                    out += ids
        return out

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of many documents: `ends` are the n + 1 places at which their ids begin and end."""
        good = (ids >= 0) & (ids < len(self.first) - 1)
        ids, ends = ids[good], running(good)[ends]
        begins, sizes = self.first[ids], self.first[ids + 1] - self.first[ids]
        at = running(sizes)
        places = np.repeat(begins - at[:-1], sizes) + np.arange(at[-1])
        raw = self.bytes[places].tobytes()
        cuts = at[ends].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


def _with(docs: DataFrame, read: str, add: list[tuple[str, T.DataType]], make) -> DataFrame:
    """Adds columns that `make(column)` computes for the rows of a slice; the other columns pass through."""
    ship(docs.sparkSession)
    names = {n.lower() for n, _ in add}
    kept = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in names], F.col(quoted(read)).alias(private(docs, "read")))
    schema = T.StructType(kept.schema.fields[:-1] + [T.StructField(n, t) for n, t in add])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, len(schema) - len(add)):
            columns = part.columns
            yield pa.RecordBatch.from_arrays([*columns[:-1], *make(columns[-1])], names=schema.names)

    # Numbered names, as names with dots cannot be passed.
    return kept.toDF(*[f"c{k}" for k in range(len(kept.columns))]).mapInArrow(run, schema)


IDS = T.ArrayType(T.IntegerType(), False)


def _ids(coder: BytePairs, texts: pa.Array) -> pa.Array:
    found = [coder.encode(text) for text in texts.to_pylist()]
    ends = running(np.fromiter(map(len, found), np.int64, len(found)))
    flat = np.fromiter((i for ids in found for i in ids), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat),
                                    type=pa.list_(pa.field("element", pa.int32(), False)))


def _texts(coder: BytePairs, ids: pa.Array) -> pa.Array:
    sizes = np.asarray(pa.compute.list_value_length(ids).fill_null(0))
    flat = np.asarray(ids.flatten().fill_null(-1)).astype(np.int64)
    return pa.array(coder.decode(flat, running(sizes)), pa.string())


def encode(docs: DataFrame, tokenizer: str | None = None, column: str = "text", to: str = "ids") -> DataFrame:
    """Adds `to`, the ids of `column`: an array of int."""
    path = tokenizer or default_tokenizer()
    return _with(docs, column, [(to, IDS)], lambda texts: [_ids(byte_pairs(path), texts)])


def decode(rows: DataFrame, tokenizer: str | None = None, column: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds `to`, the text of the ids in `column`."""
    path = tokenizer or default_tokenizer()
    as_long = rows.withColumn(column, F.col(column).cast("array<int>"))
    return _with(as_long, column, [(to, T.StringType())], lambda ids: [_texts(byte_pairs(path), ids)])


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Adds `ids` and `decoded`, the text of those ids, in one pass over the texts."""
    path = tokenizer or default_tokenizer()

    def make(texts: pa.Array) -> list[pa.Array]:
        coder = byte_pairs(path)
        ids = _ids(coder, texts)
        return [ids, _texts(coder, ids)]

    return _with(docs, "text", [("ids", IDS), ("decoded", T.StringType())], make)


def coding_report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    coded = round_trip(docs.select("doc_id", "text"), tokenizer)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
