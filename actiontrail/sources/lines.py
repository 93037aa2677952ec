"""Artifacts on disk: inventory, numbered lines, digests."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from actiontrail.session import checkpoint_dir, ship

# Path shapes per agent, tested in this order.
PATH_SHAPES = (
    ("cowork", r"/local-agent-mode-sessions/.*audit\.jsonl\z"),
    ("claude-code", r"/\.claude/(?:projects/.+\.jsonl|history\.jsonl)\z"),
    ("codex", r"/\.codex/(?:sessions|archived_sessions)/.*rollout-[^/]*\.jsonl(?:\.zst)?\z|/\.codex/history\.jsonl\z"),
    ("gemini-cli", r"/\.gemini/tmp/.*(?:logs\.json|checkpoint[^/]*\.json|chats/[^/]+\.jsonl?)\z"),
    ("cursor", r"/\.cursor/.*\.jsonl\z"),
    ("windsurf", r"/(?:\.codeium/windsurf|\.windsurf)/.*\.jsonl\z"),
    ("copilot", r"/\.copilot/.*\.jsonl\z"),
    ("opencode", r"/opencode/storage/(?:message|part|session)/.*\.json\z"),
    ("openclaw", r"/\.(?:openclaw|clawdbot)/.*\.jsonl\z"),
    ("pi", r"/\.pi/agent/sessions/.*\.jsonl\z"),
    ("kimi-code", r"/\.kimi(?:-code)?/.*wire\.jsonl\z"),
)
# Journals of workflows share the transcripts' extension and place, but are not transcripts.
WORKFLOW_JOURNAL = r"(?i)/\.claude/projects/.*/subagents/workflows/.*journal\.jsonl\z"
FALLBACK_AGENT = "claude-code"
# Folders under a home that hold artifacts. Spark's listing skips
# dot folders it meets on the way down, so they have to be named as roots.
AGENT_FOLDERS = (
    ".claude", ".codex", ".gemini/tmp", ".cursor", ".codeium/windsurf", ".windsurf", ".copilot",
    ".local/share/opencode/storage", ".openclaw", ".clawdbot", ".pi/agent/sessions", ".kimi-code", ".kimi",
    "Library/Application Support/Claude/local-agent-mode-sessions", "AppData/Roaming/Claude/local-agent-mode-sessions",
    ".config/Claude/local-agent-mode-sessions",
)


def agent_roots(home: str) -> list[str]:
    """Glob roots for one home folder or a pattern of homes (`/home/*`)."""
    return [f"{home.rstrip('/')}/{folder}" for folder in AGENT_FOLDERS]


def classify_path(path: Column) -> Column:
    slashed = F.translate(path, "\\", "/")
    out: Column = F.lit(None).cast("string")
    for agent, shape in reversed(PATH_SHAPES):
        out = F.when(slashed.rlike(shape), agent).otherwise(out)
    known_root = r"/\.(?:codex|gemini|cursor|codeium|windsurf|copilot|openclaw|clawdbot|pi|kimi(?:-code)?)/|/opencode/"
    bare = slashed.rlike(r"\.jsonl\z") & ~slashed.rlike(known_root)
    return F.when(~slashed.rlike(WORKFLOW_JOURNAL), F.coalesce(out, F.when(bare, FALLBACK_AGENT)))



def inventory(spark: SparkSession, *roots: str) -> DataFrame:
    """Every file under the roots with its agent; each path once."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
             .select(F.regexp_replace("path", r"\Afile:/+", "/").alias("local_path"), "length",
                     "modificationTime"))
    return (files.withColumn("source_agent", classify_path(F.col("local_path")))
            .dropDuplicates(["local_path"]))


def digests(spark: SparkSession, *roots: str, max_bytes: int | None = None) -> DataFrame:
    """Whole-file SHA-256. `max_bytes` leaves larger files out, as a file is one row here."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
            .where(F.lit(True) if max_bytes is None else F.col("length") <= max_bytes)
            .select(F.regexp_replace("path", r"\Afile:/+", "/").alias("local_path"),
                    F.sha2("content", 256).alias("sha256")))


def numbered_lines(spark: SparkSession, *roots: str, max_file_bytes: int | None = None,
                   max_line_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """`(lines, diagnostics)`: local_path, line, raw, sha256.

    Files are read in splits; a line's number is its rank inside its split plus the lines of the file's earlier
    splits, so no task holds more of a file than a split. Nothing is left out unless a limit is asked for; what a
    limit leaves out becomes diagnostics.
    """
    raw = (spark.read.option("recursiveFileLookup", "true").text(list(roots))
           .select(F.col("value").alias("raw"), F.regexp_replace("_metadata.file_path", r"\Afile:/+", "/").alias("local_path"),
                   F.col("_metadata.file_size").alias("_size"),
                   F.col("_metadata.file_block_start").alias("_block")))
    fits = F.lit(True) if max_file_bytes is None else F.col("_size") <= max_file_bytes
    placed = raw.where(fits).withColumn("_at", F.monotonically_increasing_id())
    before = Window.partitionBy("local_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (placed.groupBy("local_path", "_block").agg(F.count(F.lit(1)).alias("_n"))
              .select("local_path", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("local_path", "_block").orderBy("_at")
    lines = placed.join(splits, ["local_path", "_block"]).withColumn("line", (F.col("_before") + F.row_number().over(inside)).cast("bigint"))
    short = F.lit(True) if max_line_bytes is None else F.octet_length("raw") <= max_line_bytes
    kept = lines.where(short).select("local_path", "line", "raw").join(
        digests(spark, *roots, max_bytes=max_file_bytes), "local_path", "left")
    notes = (lines.where(~short).select(F.col("local_path").alias("path"), "line",
                                        F.lit("line exceeds size cap; skipped").alias("message"))
             .unionByName(inventory(spark, *roots).where(~(F.lit(True) if max_file_bytes is None else F.col("length") <= max_file_bytes)).select(
                 F.col("local_path").alias("path"), F.lit(None).cast("bigint").alias("line"),
                 F.lit("file exceeds size cap; skipped").alias("message"))))
    return kept, notes


# --- lines and digest in one pass ------------------------------------------------

READ_ROWS = "kind string, local_path string, line bigint, raw string, sha256 string, n_bytes bigint, n_lines bigint"
BUFFER_BYTES = 32 << 20


def _reader(max_line_bytes: int | None, buffer_bytes: int):
    """Reads files (uri, local_path) from front to back: rows of lines, and one row of facts for each file."""
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        from actiontrail.sources.appended import CHUNK_BYTES, split_lines

        names = ["kind", "local_path", "line", "raw", "sha256", "n_bytes", "n_lines"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

        def batch(rows):
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        class Hashed:
            """The file's own bytes, hashed as they pass."""

            closed = False

            def __init__(self, stream):
                self.stream, self.digest, self.count = stream, hashlib.sha256(), 0

            def read(self, size=-1):
                data = self.stream.read(CHUNK_BYTES if size is None or size < 0 else size)
                self.digest.update(data)
                self.count += len(data)
                return data

            def readable(self):
                return True

            def close(self):
                self.closed = True

        def chunks(stream):
            while data := stream.read(CHUNK_BYTES):
                yield bytes(data)

        for files in batches:
            for uri, path in zip(files.column(0).to_pylist(), files.column(1).to_pylist()):
                system, inner = fs.FileSystem.from_uri(uri)
                with system.open_input_stream(inner, compression=None) as raw:
                    source = Hashed(raw)
                    codec = {"gz": "gzip", "zst": "zstd", "bz2": "bz2"}.get(path.rsplit(".", 1)[-1])
                    stream = pa.CompressedInputStream(pa.PythonFile(source, "r"), codec) if codec else source
                    rows, held, number, early = [], 0, 0, True
                    for _, data, size, _ in split_lines(chunks(stream), 0, max_line_bytes):
                        number += 1
                        text = None if data is None else data.decode("utf-8", "replace")
                        rows.append(("long" if data is None else "line", path, number, text, None, size, None))
                        held += 100 + (len(data) if data is not None else 0)
                        if held >= buffer_bytes:
                            # The digest is not known yet; it follows with the facts.
                            early = False
                            yield batch(rows)
                            rows, held = [], 0
                    while source.read():
                        pass
                    digest = source.digest.hexdigest()
                    if early:
                        rows = [(*row[:4], digest, *row[5:]) for row in rows]
                    rows.append(("facts" if early else "late", path, None, None, digest, source.count, number))
                    for at in range(0, len(rows), 10_000):
                        yield batch(rows[at:at + 10_000])
    return run


def _read_once(spark: SparkSession, roots: tuple[str, ...], max_file_bytes: int | None, max_line_bytes: int | None, buffer_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the files, saved; files that are too large)."""
    ship(spark)
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
              .select("path", F.regexp_replace("path", r"\Afile:/+", "/").alias("local_path"), "length").dropDuplicates(["local_path"]))
    fits = F.lit(True) if max_file_bytes is None else F.col("length") <= max_file_bytes
    uri = F.regexp_replace("path", r"\Afile:/+", "file:///")
    todo = listed.where(fits).select(uri.alias("uri"), "local_path").repartition("local_path")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    todo.mapInArrow(_reader(max_line_bytes, buffer_bytes), READ_ROWS).write.partitionBy("kind").parquet(folder)
    return spark.read.schema(READ_ROWS).parquet(folder), listed.where(~fits)


def file_facts(spark: SparkSession, *roots: str, max_line_bytes: int | None = None, buffer_bytes: int = BUFFER_BYTES) -> DataFrame:
    """local_path, n_bytes, n_lines, sha256 of every file, read once."""
    rows, _ = _read_once(spark, roots, None, max_line_bytes, buffer_bytes)
    return rows.where(F.col("kind").isin("facts", "late")).select("local_path", "n_bytes", "n_lines", "sha256")


def hashed_lines(spark: SparkSession, *roots: str, max_file_bytes: int | None = None, max_line_bytes: int | None = None,
                 buffer_bytes: int = BUFFER_BYTES) -> tuple[DataFrame, DataFrame]:
    """`numbered_lines` in one pass: each file is read once, by one task, which hashes what it cuts into lines.

    The lines are written to the shared folder, where later jobs read them in splits. No row holds a file: lines of a
    file of up to `buffer_bytes` get its digest at once; of larger files the digest is known last and is joined to the lines, by
    the paths of such files alone. Files ending in .gz, .zst or .bz2 are unpacked; the digest is of the file as it is.
    Files are opened by their URI in the tasks (local or shared folders, HDFS, object stores); `numbered_lines` reads what only Spark can open.
    """
    rows, large = _read_once(spark, roots, max_file_bytes, max_line_bytes, buffer_bytes)
    late = rows.where("kind = 'late'").select(F.col("local_path").alias("_path"), F.col("sha256").alias("_late"))
    # Lines that have their digest look for no path.
    waiting = F.when(F.col("sha256").isNull(), F.col("local_path"))
    kept = (rows.where("kind = 'line'").join(late, waiting == F.col("_path"), "left")
            .select("local_path", "line", "raw", F.coalesce("sha256", "_late").alias("sha256")))
    notes = (rows.where("kind = 'long'").select(F.col("local_path").alias("path"), "line", F.lit("line exceeds size cap; skipped").alias("message"))
             .unionByName(large.select(F.col("local_path").alias("path"), F.lit(None).cast("bigint").alias("line"),
                                       F.lit("file exceeds size cap; skipped").alias("message"))))
    return kept, notes
