"""Best-fit packing of token sequences, planned on the histogram of lengths.

`pieces` encodes every text and cuts what is longer than a sequence. `plan` sees only how many pieces each length
has (at most `capacity` numbers, whatever the corpus) and runs best-fit decreasing over those counts: it moves
whole runs of equal, equally filled sequences at once and gives slots "the pieces of length L with ranks from r on
fill sequences from s on, k in each, from offset o on". `pack` ranks pieces within their length, spread over
buckets, and joins them with the slots by length and rank.

Null and empty texts have one piece with the end id only. Repeated rows are packed as often as they occur; a null
doc_id is kept. The columns added here replace input columns of the same names; others are kept.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actiontrail.llm.shared import ranked, saved, ship, spread_count
from actiontrail.llm.tokens import default_tokenizer, encoder

CAPACITY = 4096
END_ID = 1
PIECES = "piece int, start long, length long, ids binary"
SLOTS = T.StructType([T.StructField("length", T.LongType())] + [
    T.StructField(n, T.LongType()) for n in ("rank_from", "rank_to", "first_sequence", "each", "base")])


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id and (piece, start, length, ids): ids are little-endian unsigned 32-bit."""
    path = tokenizer or default_tokenizer()
    ship(docs.sparkSession)
    end = end_id.to_bytes(4, "little")
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                source, piece, start, length, ids = [], [], [], [], []
                for row, raw in enumerate(coder.encode(part.column(1).to_pylist())):
                    raw += end
                    for k, begin in enumerate(range(0, len(raw), capacity * 4)):
                        own = raw[begin:begin + capacity * 4]
                        source.append(row)
                        piece.append(k)
                        start.append(begin // 4)
                        length.append(len(own) // 4)
                        ids.append(own)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type.simpleString()}, {PIECES}")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: slot rows and the number of sequences."""
    open_runs: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, how many)
    rooms: list[int] = []
    slots, used = [], 0

    def keep(room: int, first: int, many: int) -> None:
        if room <= 0 or many <= 0:
            return
        if room not in open_runs:
            open_runs[room] = []
            bisect.insort(rooms, room)
        open_runs[room].append((first, many))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                room, first, many = capacity, used, -(-left // each)
                used += many
            else:
                room = rooms[at]
                first, many = open_runs[room].pop()
                if not open_runs[room]:
                    del open_runs[room], rooms[at]
                each = room // length
            full = min(many, left // each)
            base = capacity - room
            if full:
                slots.append((length, rank, rank + full * each, first, each, base))
                keep(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < many and left:  # fewer than `each` are left: they share one sequence
                slots.append((length, rank, rank + left, first + full, left, base))
                keep(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            keep(room, first + full, many - full)
    return slots, used


def slot_table(spark: SparkSession, cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The plan as a table; its size depends on the lengths that occur, never on the number of pieces."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    return spark.createDataFrame(plan(counts, capacity)[0], SLOTS)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces; `cut` should be saved, as it is read twice."""
    spark = cut.sparkSession
    plain = cut.drop("sequence_id", "offset", "rank")
    order = [c for c in ("doc_id", "piece") if c in plain.columns]
    rows = ranked(plain, "length", order, spread_count(cut), "rank")
    slots = slot_table(spark, cut, capacity).withColumnRenamed("length", "_length")
    hit = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    nth = F.col("rank") - F.col("rank_from")
    return (rows.join(F.broadcast(slots), hit)
            .withColumn("sequence_id", (F.col("first_sequence") + F.floor(nth / F.col("each"))).cast("long"))
            .withColumn("offset", (F.col("base") + F.pmod(nth, F.col("each")) * F.col("length")).cast("long"))
            .drop("rank", "_length", "rank_from", "rank_to", "first_sequence", "each", "base"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: one row of joined ids for each sequence, at most `capacity` ids long."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = saved(pieces(docs, tokenizer, capacity)
                .select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(cut, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
