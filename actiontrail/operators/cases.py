"""Case exports: cited rows, manifests, digest drift."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from actiontrail.functions.scalars import order_key
from actiontrail.operators.dedupe import first_per_id
from actiontrail.session import ship
from actiontrail.sources.publish import exists, publish_once, read_text
from actiontrail.sources.records import as_lines

_CASE_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,127}")

# Rows of a written file, and bytes of a file that is hashed in one piece; longer ones are hashed line by line.
FILE_ROWS = 20_000
FILE_BYTES = 32 << 20


def citations(findings: DataFrame) -> DataFrame:
    return findings.select(F.explode("cited_event_ids").alias("event_id")).distinct()


def cited_events(events: DataFrame, findings: DataFrame) -> DataFrame:
    return events.join(citations(findings), "event_id", "left_semi")


def missing_citations(events: DataFrame, findings: DataFrame) -> DataFrame:
    return citations(findings).join(events.select("event_id"), "event_id", "left_anti")


def case_findings(findings: DataFrame, case_id: str) -> DataFrame:
    return findings.where(F.col("case_id") == case_id)


def case_records(events: DataFrame, findings: DataFrame, decisions: DataFrame, case_id: str,
                 order: str) -> dict[str, DataFrame]:
    """The rows of one case, first copy of each id, in bundle order."""
    mine = first_per_id(case_findings(findings, case_id), "finding_id", order)
    ev = first_per_id(cited_events(events, mine), "event_id", order)
    dec = first_per_id(decisions.where(F.col("case_id") == case_id), "decision_id", order)
    return {
        "findings": mine.orderBy(order_key("timestamp"), "finding_id"),
        "events": ev.orderBy(order_key("timestamp"), "event_id"),
        "decisions": dec.orderBy(order_key("timestamp"), "decision_id"),
    }


def write_case(records: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Writes one folder of NDJSON files for each kind of record; returns their manifest."""
    for kind, rows in records.items():
        as_lines(rows).select("value").write.option("maxRecordsPerFile", FILE_ROWS).text(f"{folder}/{kind}")
    return manifest(next(iter(records.values())).sparkSession, folder, list(records))


def publish_case(records: Mapping[str, DataFrame], root: str, case_id: str) -> DataFrame:
    """Writes a case so that it appears whole or not at all; returns its manifest.

    Rows go to a folder of this attempt below `root/staging`; its manifest is written when all of them are there, and the file
    `root/cases/<case_id>`, which names the folder, comes last. A writer that dies leaves a folder that nothing names. A
    case that exists is refused, also where two writers race.
    """
    if not _CASE_ID.fullmatch(case_id):
        raise ValueError(f"not a case id: {case_id!r}")
    spark = next(iter(records.values())).sparkSession
    if exists(spark, f"{root}/cases/{case_id}"):
        raise FileExistsError(f"case {case_id} exists")
    folder = f"{root}/staging/{case_id}-{uuid.uuid4().hex}"
    write_case(records, folder).write.json(f"{folder}/manifest")
    publish_once(spark, f"{root}/cases/{case_id}", folder)
    return case_manifest(spark, root, case_id)


def case_folder(spark: SparkSession, root: str, case_id: str) -> str:
    """Where a published case lies; raises FileNotFoundError for one that is not (or not yet) published."""
    if not _CASE_ID.fullmatch(case_id) or not exists(spark, f"{root}/cases/{case_id}"):
        raise FileNotFoundError(f"no case {case_id}")
    return read_text(spark, f"{root}/cases/{case_id}")


def case_manifest(spark: SparkSession, root: str, case_id: str) -> DataFrame:
    return spark.read.schema("path string, sha256 string, row_count bigint").json(f"{case_folder(spark, root, case_id)}/manifest")


def verify_case(spark: SparkSession, root: str, case_id: str, kinds: Sequence[str]) -> DataFrame:
    """(path, problem) of a published case whose files are not what its manifest says; no rows: all is well."""
    listed = case_manifest(spark, root, case_id)
    return manifest_problems(listed, manifest(spark, case_folder(spark, root, case_id), kinds))


def manifest(spark: SparkSession, folder: str, kinds: Sequence[str]) -> DataFrame:
    """path (below the folder), sha256 and row_count of every written file; row counts come from the files as they lie there."""
    roots = [f"{folder}/{kind}" for kind in kinds]
    below = lambda path: F.concat_ws("/", F.element_at(F.split(path, "/"), -2), F.element_at(F.split(path, "/"), -1))
    short = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(roots).where(F.col("length") <= FILE_BYTES).select(
        below(F.col("path")).alias("path"), F.sha2("content", 256).alias("sha256"))
    digests = short.unionByName(long_digests(spark, roots).withColumn("path", below(F.col("path"))))
    counts = (spark.read.option("pathGlobFilter", "part-*").text(roots).groupBy(below(F.col("_metadata.file_path")).alias("path"))
              .agg(F.count(F.lit(1)).alias("row_count")))
    return digests.join(counts, "path", "left").select("path", "sha256", F.coalesce("row_count", F.lit(0).cast("bigint")).alias("row_count"))


def long_digests(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """path and sha256 of files above FILE_BYTES: their lines in order, hashed as they pass, so no task holds a file."""
    ship(spark)
    meta = {name: F.col(f"_metadata.{name}").alias(name) for name in ("file_path", "file_size", "file_block_start")}
    lines = (spark.read.option("pathGlobFilter", "part-*").option("lineSep", "\n").text(list(roots))
             .where(F.col("_metadata.file_size") > FILE_BYTES)
             .select(*meta.values(), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line")))
    order = ["file_path", "file_block_start", "at"]
    return (lines.repartition("file_path").sortWithinPartitions(*order).select("file_path", "file_size", "line")
            .mapInArrow(_hash_lines, "path string, sha256 string"))


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of rows of one file; its size says whether its last line has an end."""
    done, path, digest, left = [], None, hashlib.sha256(), 0
    for batch in batches:
        for name, size, line in zip(*(batch.column(c) for c in ("file_path", "file_size", "line"))):
            if name.as_py() != path:
                if path is not None:
                    done.append((path, digest.hexdigest()))
                path, digest, left = name.as_py(), hashlib.sha256(), size.as_py()
            data = line.as_py()
            digest.update(data)
            left -= len(data)
            if left > 0:
                digest.update(b"\n")
                left -= 1
    if path is not None:
        done.append((path, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], names=["path", "sha256"])


def digest_drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Paths where any recorded digest differs from the current one.

    `recorded`: local_path, sha256 (many per path); `current`: local_path, sha256.
    Two-phase aggregate: min and max tell whether all recorded digests agree.
    """
    seen = (recorded.where(F.col("sha256").isNotNull()).groupBy("local_path")
            .agg(F.min("sha256").alias("_lo"), F.max("sha256").alias("_hi")))
    now = current.select("local_path", F.col("sha256").alias("current_sha256"))
    return (seen.join(now, "local_path")
            .where((F.col("_lo") != F.col("current_sha256")) | (F.col("_hi") != F.col("current_sha256")))
            .select("local_path", "current_sha256"))


def manifest_problems(listed: DataFrame, present: DataFrame) -> DataFrame:
    """Full outer comparison of a manifest with the files found.

    Both sides: path, sha256, row_count.
    """
    a = listed.select("path", F.col("sha256").alias("want_sha"), F.col("row_count").alias("want_rows"))
    b = present.select("path", F.col("sha256").alias("have_sha"), F.col("row_count").alias("have_rows"))
    problem = (F.when(F.col("have_sha").isNull(), "missing")
               .when(F.col("want_sha").isNull(), "unlisted")
               .when(F.col("want_sha") != F.col("have_sha"), "digest_mismatch")
               .when(F.col("want_rows") != F.col("have_rows"), "row_count_mismatch"))
    return a.join(b, "path", "full_outer").withColumn("problem", problem).where(
        F.col("problem").isNotNull()).select("path", "problem")
