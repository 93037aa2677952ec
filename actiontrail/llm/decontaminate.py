"""Benchmark decontamination with an FM-index for each shard of training texts.

Words are runs of digits, a-z (A-Z is lower-cased) and bytes from 0x80 on. A benchmark item's windows are its runs of
`WINDOW` words; an item with fewer words, but not none, is one window. A shard is a slice of a task's texts. Words that no item
has, and words that stand beside no neighbour they have in an item, cannot lie in a window; such stretches fold into one
separator. Over what is left an FM-index is built; every window is searched backward through it, occurrences are
located by sampled suffix positions, and the hit spans are merged.

The benchmark is the stated query set: it is dealt out in blocks of at most `BLOCK_WORDS` words, kept as files in the
shared folder, and every shard is searched for each block. Words are compared by 64-bit hashes. Null texts have no words;
a null item_id is named "null"; rows of the same item_id are one item. Repeated documents are searched each; columns of
the names added here are replaced, others kept.
"""

from __future__ import annotations

import functools
import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actiontrail.llm.fm_index import FMIndex
from actiontrail.llm.shared import get, put, scratch, ship
from actiontrail.llm.text_bytes import parts, prefix_hash, span_hash, texts

WINDOW = 10
BLOCK_WORDS = 1_000_000
ADDED = ("n_words", "n_hit", "items", "spans")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[128:] = _WORD[48:58] = _WORD[97:123] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text number and hash of each word."""
    low = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, owner, span_hash(prefix_hash(low), starts, ends)


def block_of(names: list[str], phrases: list[str]) -> dict[str, np.ndarray]:
    """What a search needs of some items: vocabulary, neighbours, distinct windows and who has them."""
    data, offsets = texts(pa.array(phrases, pa.string()))
    _, _, owner, words = word_spans(data, offsets)
    vocabulary, symbol = np.unique(words, return_inverse=True)
    symbol = symbol + 1
    same = owner[1:] == owner[:-1]
    pairs = np.unique(symbol[:-1][same] * (len(vocabulary) + 1) + symbol[1:][same])
    windows, of = [], []
    bounds = np.searchsorted(owner, np.arange(len(phrases) + 1))
    for item in range(len(phrases)):
        own = symbol[bounds[item]:bounds[item + 1]]
        if not len(own):
            continue
        rows = np.lib.stride_tricks.sliding_window_view(own, min(WINDOW, len(own)))
        full = np.zeros((len(rows), WINDOW), np.int64)
        full[:, WINDOW - rows.shape[1]:] = rows
        windows.append(full)
        of.append(np.full(len(rows), item))
    stacked = np.concatenate(windows) if windows else np.zeros((0, WINDOW), np.int64)
    distinct, number = np.unique(stacked, axis=0, return_inverse=True)
    links = np.unique(np.stack([number.ravel(), np.concatenate(of) if of else np.zeros(0, int)], 1), axis=0)
    return {"vocabulary": vocabulary, "pairs": pairs, "windows": distinct, "links": links, "names": np.asarray(names, str),
            "alone": np.unique(distinct[(distinct[:, :-1] == 0).all(1), -1]) if len(distinct) else np.zeros(0, int)}


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> list[str]:
    """Writes the items in blocks to the shared folder; the driver holds one block at a time."""
    folder, out, names, phrases, size = scratch(benchmark.sparkSession, "benchmark"), [], [], [], 0

    def close() -> None:
        file = io.BytesIO()
        np.savez(file, **block_of(names, phrases))
        out.append(f"{folder}/block{len(out):05d}.npz")
        put(out[-1], file.getvalue())

    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").toLocalIterator():
        names.append(row[0])
        phrases.append(row[1])
        size += len(row[1] or "") // 4 + 1
        if size >= block_words:
            close()
            names, phrases, size = [], [], 0
    if names:
        close()
    return out


@functools.lru_cache(maxsize=2)
def _load(path: str) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(get(path))))


def hits(words: np.ndarray, owner: np.ndarray, block: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of a block's windows: first word, number of words, window number."""
    vocabulary = block["vocabulary"]
    none = np.zeros(0, np.int64)
    if not len(vocabulary) or not len(words):
        return none, none, none
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    symbol = np.where(vocabulary[at] == words, at + 1, 0)
    beside = (owner[1:] == owner[:-1]) & np.isin(symbol[:-1] * (len(vocabulary) + 1) + symbol[1:], block["pairs"])
    beside &= (symbol[:-1] > 0) & (symbol[1:] > 0)
    keep = np.isin(symbol, block["alone"]) & (symbol > 0)
    keep[1:] |= beside
    keep[:-1] |= beside
    # A separator goes before a kept word whose left neighbour is folded or that does not follow on in an item.
    places = np.flatnonzero(keep)
    if not len(places):
        return none, none, none
    joined = np.zeros(len(places), bool)
    joined[1:] = (places[1:] == places[:-1] + 1) & beside[np.maximum(places[1:] - 1, 0)]
    target = np.arange(len(places)) + np.cumsum(~joined) - 1
    folded = np.zeros(target[-1] + 2, np.int64)
    folded[target] = symbol[places]
    origin = np.zeros(len(folded), np.int64)
    origin[target] = places
    index = FMIndex(folded, len(vocabulary) + 1)
    lengths = (block["windows"] > 0).sum(1)
    found, low, high = index.search(block["windows"], lengths)
    many = high - low
    rows = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    window = np.repeat(found, many)
    return origin[index.locate(rows)], lengths[window], window


def search(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds n_words, n_hit, items (sorted ids) and spans: merged (first byte, last byte + 1) of hit words."""
    ship(docs.sparkSession)
    paths = blocks(benchmark, block_words)
    plain = docs.drop(*ADDED)
    fields, place = plain.schema.fields, plain.columns.index("text")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType(fields + [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                                    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, place):
            data, offsets = texts(part.column(place))
            many = part.num_rows
            starts, ends, owner, words = word_spans(data, offsets)
            edge = np.zeros(len(words) + 1, np.int64)
            items: list[set[str]] = [set() for _ in range(many)]
            for path in paths:
                block = _load(path)
                first, length, window = hits(words, owner, block)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + length, -1)
                pairs = np.unique(np.stack([owner[first], window], 1), axis=0)
                begin = np.searchsorted(block["links"][:, 0], pairs[:, 1], "left")
                end = np.searchsorted(block["links"][:, 0], pairs[:, 1], "right")
                for row, b, e in zip(pairs[:, 0].tolist(), begin.tolist(), end.tolist()):
                    items[row].update(block["names"][block["links"][b:e, 1]].tolist())
            hit = np.cumsum(edge[:-1]) > 0
            spans: list[list[dict[str, int]]] = [[] for _ in range(many)]
            on = np.flatnonzero(hit)
            if len(on):
                new = np.ones(len(on), bool)
                new[1:] = (on[1:] != on[:-1] + 1) | (owner[on[1:]] != owner[on[:-1]])
                begins = on[new]
                stops = on[np.append(np.flatnonzero(new)[1:] - 1, len(on) - 1)]
                for row, b, e in zip(owner[begins].tolist(), starts[begins].tolist(), ends[stops].tolist()):
                    spans[row].append({"start": b - int(offsets[row]), "end": e - int(offsets[row])})
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(np.bincount(owner, minlength=many)),
                 pa.array(np.bincount(owner[hit], minlength=many)), pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=schema.fieldNames())

    return plain.mapInArrow(run, schema)


def without_spans(found: DataFrame) -> DataFrame:
    """The texts with their spans cut out; documents without any word left go."""
    raw = F.col("text").cast("binary")
    # Pieces between spans: from each span's end to the next one's start.
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.end"))
    starts = F.concat(F.col("spans.start"), F.array(F.octet_length("text").cast("long")))
    cut = F.aggregate(F.arrays_zip(ends.alias("a"), starts.alias("b")), F.lit(b""), lambda out, p: F.concat(
        out, F.substring(raw, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int"))))
    return (found.where(F.col("n_hit").eqNullSafe(0) | (F.col("n_words") > F.col("n_hit")))
            .withColumn("text", F.when(F.size("spans") > 0, F.decode(cut, "UTF-8")).otherwise(F.col("text"))))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return search(docs.select("doc_id", "text"), benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def brute_words(text: str | None) -> list[str]:
    """The words of one text the plain way, for tests."""
    import re

    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
