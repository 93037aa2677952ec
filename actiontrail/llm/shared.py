"""Helpers of the training-data operators: shipping code, scratch tables and files in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from actiontrail.session import checkpoint_dir

ASIDE = "other_columns"
_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="actiontrail-"), "actiontrail_src.zip")
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, str(file.relative_to(root.parent)))
    context.addPyFile(target)
    _SHIPPED[context.applicationId] = target


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder; Hadoop removes it when the driver ends."""
    base = checkpoint_dir(spark)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base
    folder = f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark, name)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attempt_name() -> str:
    """A file name no other task attempt uses; readers follow the committed manifest, so orphans do no harm."""
    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    system, path = filesystem(uri)
    with system.open_output_stream(path, compression=None) as out:
        out.write(data)


def get(uri: str, start: int = 0, length: int | None = None) -> bytes:
    system, path = filesystem(uri)
    with system.open_input_file(path) as file:
        if start:
            file.seek(start)
        return file.read() if length is None else file.read(length)


def private(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have, in any spelling."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    """A column's name as a reference, whatever letters it has."""
    return "`" + name.replace("`", "``") + "`"


def aside(docs: DataFrame, own: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(documents whose other columns are put into one, what takes them out again): no name of theirs can meet one of an operator.

    The second gives the columns of `docs` in their order, then those that the operator added.
    """
    names = docs.columns
    others = [c for c in names if c.lower() not in own]
    if not others:
        return docs, lambda out: out
    inner = docs.select(*own, F.struct(*[F.col(quoted(c)) for c in others]).alias(ASIDE))

    def back(out: DataFrame) -> DataFrame:
        kept = [F.col(f"{ASIDE}.{quoted(c)}") if c in others else F.col(quoted(c)) for c in names]
        return out.select(*kept, *[c for c in out.columns if c.lower() not in own and c != ASIDE])

    return inner, back


def spread_count(df: DataFrame, least: int = 8) -> int:
    """Buckets that follow the cluster's shuffle width."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ranked(df: DataFrame, group: str, order: list[str], buckets: int, to: str) -> DataFrame:
    """Adds `to`: a gapless 0-based number inside `group`, without bringing a group into one task.

    A row's bucket is a hash of `order`; rows are numbered inside (group, bucket) and shifted by the counts of the
    group's earlier buckets, of which there are at most `buckets`.
    """
    placed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    sizes = placed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias("_group"), F.col("_bucket").alias("_at"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = placed.withColumn("_inside", F.row_number().over(inside) - 1)
    return (numbered.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_at")))
            .withColumn(to, (F.col("_inside") + F.col("_start")).cast("long"))
            .drop("_bucket", "_inside", "_group", "_at", "_start"))
