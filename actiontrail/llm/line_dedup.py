"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased; only keys of at least
`MIN_CHARS` code points count. A store holds, for each key, one entry: in how many documents it was seen and the largest doc_id
among them. Documents come in batches. A batch is aggregated to keys and merge-joined with the runs: what the anti-join leaves
opens entries, a new sorted run of the lowest level; keys that have an entry somewhere become updates of that run. When a level holds
`FANOUT` runs they are compacted into one run of the next level: entries are put together as they are, since no key has two, and
updates are folded into the entries that they find there; others go on as updates until they meet theirs. So a store of n batches
has O(log n) runs, and later batches meet compacted ones. At the end all is compacted once more, and the counts stand
in the entries. Lines whose key has `MIN_DOCS` documents go, except in the document with the largest id that holds it.

Documents are joined back by (doc_id, hash of the text); equal rows lose the same lines. A null doc_id counts as a
document and is never the largest unless no other holds the key. Null text: one empty line. Other columns are kept, whatever their names;
columns named n_lines and n_dropped are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actiontrail.llm.shared import private, saved, scratch

MIN_CHARS = 40
MIN_DOCS = 5
FANOUT = 3
BATCHES = 5
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = ("h1", "h2")


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def with_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """row_hash and keys: for each long enough line its number and 128-bit key hash."""
    # Code points of a trimmed line are at most those of the line, so short lines are dropped before any other work.
    numbered = F.transform(text_lines(F.col("text")), lambda x, i: F.when(F.char_length(x) >= min_chars, F.struct(i.alias("at"), x.alias("line"))))
    keyed = F.transform(F.array_compact(numbered), lambda s: F.struct(s["at"].alias("at"), line_key(s["line"]).alias("key")))
    long = F.filter(keyed, lambda s: F.char_length(s["key"]) >= min_chars)
    keys = F.transform(long, lambda s: F.struct(s["at"].alias("at"), F.xxhash64(s["key"]).alias("h1"),
                                                F.xxhash64(s["key"], F.lit(1)).alias("h2")))
    return docs.withColumn("row_hash", F.xxhash64("text")).withColumn("keys", keys)


def batch_keys(keyed: DataFrame) -> DataFrame:
    """One row per key of a batch: documents that hold it and the largest of their ids."""
    distinct = F.array_distinct(F.transform("keys", lambda s: F.struct(s["h1"].alias("h1"), s["h2"].alias("h2"))))
    flat = keyed.select("doc_id", F.inline(distinct))
    return flat.groupBy(*HASHES).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top_doc"))


ENTRY = [*HASHES, "n_docs", "top_doc"]


@dataclass
class Run:
    """Paths of a run's entries and updates: immutable tables sorted by hash."""

    entries: str
    updates: str


@dataclass
class RunStore:
    """Levels of runs; only their paths are kept here."""

    spark: SparkSession
    fanout: int = FANOUT
    levels: list[list[Run]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.folder, self.made = scratch(self.spark, "line-runs"), 0

    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def entries(self, runs: list[Run]) -> DataFrame:
        return self.spark.read.parquet(*[run.entries for run in runs])

    def _write(self, entries: DataFrame, updates: DataFrame, level: int) -> None:
        path = f"{self.folder}/level{level}-run{self.made:06d}"
        self.made += 1
        run = Run(f"{path}-entries", f"{path}-updates")
        entries.select(*ENTRY).sortWithinPartitions(*HASHES).write.parquet(run.entries)
        updates.select(*ENTRY).sortWithinPartitions(*HASHES).write.parquet(run.updates)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def add(self, batch: DataFrame) -> None:
        """Opens entries for a batch's new keys and notes updates for the known ones."""
        if self.runs():
            rows, seen = saved(batch, "line-batch"), self.entries(self.runs()).select(*HASHES)
            self._write(rows.join(seen, list(HASHES), "left_anti"), rows.join(seen, list(HASHES), "left_semi"), 0)
        else:
            self._write(batch, batch.limit(0), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """All runs of a level become one of the next."""
        runs, self.levels[level] = self.levels[level], []
        self._write(*self._folded(runs), level + 1)

    def _folded(self, runs: list[Run]) -> tuple[DataFrame, DataFrame]:
        entries = self.entries(runs)
        updates = saved(self.spark.read.parquet(*[run.updates for run in runs]).groupBy(*HASHES)
                        .agg(F.sum("n_docs").alias("more"), F.max("top_doc").alias("top")), "line-updates")
        folded = entries.join(updates, list(HASHES), "left").select(
            *HASHES, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("top_doc", "top").alias("top_doc"))
        later = updates.join(entries.select(*HASHES), list(HASHES), "left_anti").select(
            *HASHES, F.col("more").alias("n_docs"), F.col("top").alias("top_doc"))
        return folded, later

    def counts(self) -> DataFrame:
        """Every key's entry with all its updates."""
        return self._folded(self.runs())[0]


def build_store(keyed: DataFrame, batches: int = BATCHES) -> RunStore:
    """Feeds the documents to a store batch by batch, dealt by a hash of the row."""
    store = RunStore(keyed.sparkSession)
    for k in range(batches):
        store.add(batch_keys(keyed.where(F.pmod(F.col("row_hash"), F.lit(batches)) == k)))
    return store


def dropped_lines(keyed: DataFrame, store: RunStore, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, row_hash and the numbers of the lines that go (`gone`)."""
    # Saved, so that the join has an exchange on both sides and Spark can split the lines of a very frequent key.
    often = saved(store.counts().where(F.col("n_docs") >= min_docs).select(*HASHES, "top_doc"), "often")
    flat = keyed.select("doc_id", "row_hash", F.inline("keys"))
    hit = flat.join(often, list(HASHES)).where(~F.col("doc_id").eqNullSafe(F.col("top_doc")))
    return hit.groupBy("doc_id", "row_hash").agg(F.collect_set("at").alias("gone"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """The documents with the text that is left (never null), and n_lines and n_dropped."""
    keyed = saved(with_keys(docs.select("doc_id", "text"), min_chars).select("doc_id", "row_hash", "keys")
                  .where(F.size("keys") > 0), "line-keys")
    row, doc, own, gone, lines = (private(docs, n) for n in ("row", "doc", "own", "gone", "lines"))
    found = dropped_lines(keyed, build_store(keyed, batches), min_docs).toDF(doc, own, gone)
    rows = docs.drop("n_lines", "n_dropped").withColumn(row, F.xxhash64("text"))
    joined = rows.join(found, (F.col(row) == F.col(own)) & F.col("doc_id").eqNullSafe(F.col(doc)), "left")
    cut = joined.withColumn(lines, text_lines(F.col("text")))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    left = F.when(F.col(gone).isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(
        F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))
    return (cut.withColumn("n_lines", F.size(lines).cast("long"))
            .withColumn("n_dropped", F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long"))
            .withColumn("text", left).drop(row, own, doc, gone, lines))


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = f"""
WITH lines AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT row_id, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (
    SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), often AS (
  SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT row_id) >= {MIN_DOCS}
), marked AS (
  SELECT l.*, o.key IS NOT NULL AND l.doc_id IS DISTINCT FROM o.top AS gone FROM lines l LEFT JOIN often o USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_id
"""
