"""Quality rules: document statistics, two fixed base rules, and gradient-boosted trees over the statistics.

`with_statistics` counts over whole texts in numpy, for all texts of an Arrow batch at once. `train` fits the trees on
at most `TRAIN_ROWS` labelled documents (those with the smallest hashes of doc_id). Scores never rise with the share
of symbols, repeated words or repeated lines (monotonic constraints). `judge` adds base_failed and kept.

Words are runs without ASCII white space; lines are split at the line feed. Null and empty texts have no words, so they
fail the base rules. Without labels of both kinds there is no model and the base rules alone decide. Repeated rows are
judged alike; columns of the names added here are replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actiontrail.llm.shared import ship
from actiontrail.llm.text_bytes import mixed, parts, prefix_hash, running, span_hash, texts
from actiontrail.llm.trees import Forest, fit

TRAIN_ROWS = 8000
KEEP_FROM = 0.5
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits",
          "n_marks", "n_chars_all", "n_distinct_words")
PUBLIC = COUNTS[:5]
#: Feature number -> direction in which the score may move.
MONOTONE = {1: -1, 2: -1, 3: -1}

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_SYMBOL, _UPPER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[list(b"!?")] = True


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = running(mask)
    return sums[offsets[1:]] - sums[offsets[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The COUNTS of each text, one row per text."""
    n, many = len(data), len(offsets) - 1
    out = np.zeros((many, len(COUNTS)), np.int64)
    if not n:
        out[:, 5] = 1
        return out
    blank = _BLANK[data]
    text_starts = np.zeros(n + 1, bool)
    text_starts[offsets] = True
    solid, starts_char = ~blank, (data & 0xC0) != 0x80
    before = np.ones(n, bool)
    before[1:] = blank[:-1]
    after = np.ones(n, bool)
    after[:-1] = blank[1:]
    starts = np.flatnonzero(solid & (before | text_starts[:-1]))
    ends = np.flatnonzero(solid & (after | text_starts[1:])) + 1
    owner = np.searchsorted(offsets, starts, "right") - 1
    sums = prefix_hash(data)
    words = span_hash(sums, starts, ends)
    out[:, 0] = np.bincount(owner, minlength=many)
    out[:, 1] = _per_text(solid & starts_char, offsets)
    for k, table in ((2, _SYMBOL), (6, _UPPER), (7, _DIGIT), (8, _MARK)):
        out[:, k] = _per_text(table[data], offsets)
    out[:, 9] = _per_text(starts_char, offsets)

    feeds = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    line_ends = np.sort(np.concatenate([offsets[1:], feeds]))
    # Every text has one line more than line feeds, so starts and ends pair up in order.
    line_owner = np.repeat(np.arange(many), _per_text(data == 10, offsets) + 1)
    solids = running(solid)
    real = solids[line_ends] > solids[line_starts]
    keys = mixed(span_hash(sums, line_starts[real], line_ends[real]) + mixed(line_owner[real].astype(np.uint64)))
    first = np.unique(keys, return_index=True)[1]
    out[:, 3] = np.bincount(line_owner[real], minlength=many) - np.bincount(line_owner[real][first], minlength=many)
    out[:, 5] = np.bincount(line_owner, minlength=many)

    first = np.unique(mixed(words + mixed(owner.astype(np.uint64))), return_index=True)[1]
    out[:, 10] = np.bincount(owner[first], minlength=many)
    if len(words) >= WINDOW:
        full = len(words) - WINDOW + 1
        window = np.zeros(full, np.uint64)
        for k in range(WINDOW):
            window = window * np.uint64(0x100000001B3) + words[k:k + full]
        at = np.flatnonzero(owner[:full] == owner[WINDOW - 1:])
        window = mixed(window[at] + mixed(owner[at].astype(np.uint64)))
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, at[again], 1)
        np.add.at(edge, at[again] + WINDOW, -1)
        out[:, 4] = np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=many)
    return out


def features(counts: np.ndarray) -> np.ndarray:
    """What the trees see: shares and logarithms of the counts."""
    c = counts.astype(float)
    words, chars, lines = np.maximum(c[:, 0], 1), np.maximum(c[:, 9], 1), np.maximum(c[:, 5], 1)
    return np.stack([np.log1p(c[:, 0]), c[:, 2] / words, c[:, 4] / words, c[:, 3] / lines, c[:, 1] / words, c[:, 6] / chars,
                     c[:, 7] / chars, c[:, 8] / words, c[:, 10] / words, words / lines], 1)


def with_statistics(docs: DataFrame, model: Forest | None = None) -> DataFrame:
    """Adds the COUNTS (long) and score to the rows; without a model every score is 1."""
    ship(docs.sparkSession)
    names = list(COUNTS)
    plain = docs.drop(*names, "score")
    schema = T.StructType(plain.schema.fields + [T.StructField(n, T.LongType()) for n in names] + [T.StructField("score", T.DoubleType())])
    place = plain.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, place):
            counts = statistics(*texts(part.column(place)))
            score = model.score(features(counts)) if model is not None else np.ones(part.num_rows)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(counts[:, k]) for k in range(len(names))), pa.array(score)],
                                             names=schema.fieldNames())

    return plain.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest | None:
    """Trees fitted on at most `rows` labelled documents; None where the labels have one kind only."""
    some = (labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
            .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows))
    counted = with_statistics(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("quality", "text"))
    table = counted.select("quality", *COUNTS).limit(4 * rows).toPandas()
    y = table["quality"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    x = features(table[list(COUNTS)].to_numpy())
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows come in
    return fit(x[order], y[order], monotone=MONOTONE)


def judge(docs: DataFrame, model: Forest | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """Adds the COUNTS, score, base_failed and kept."""
    counted = with_statistics(docs.drop("base_failed", "kept"), model)
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    return (counted.withColumn("base_failed", base)
            .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= keep_from)))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    return judge(docs.select("doc_id", "text"), model).select("doc_id", *PUBLIC, "base_failed", "kept")
