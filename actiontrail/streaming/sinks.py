"""Output of `foreachBatch` that a repeated batch does not change.

Spark runs a batch again if the driver died before it noted the batch as done, so appended files would hold its rows twice. Here a batch is written
to a folder of its own attempt, and becomes visible by one small file named after the batch, which is made by a rename that
never replaces another. A batch that has such a file is not written again; folders of attempts without one are never read.

    root/data/_attempt=<batch>-<random>/…      root/commits/<batch>
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from actiontrail.sources.publish import exists, publish_once


class CommittedSink:
    """Writes batches under `root`; give `sink.write` to `foreachBatch`, one sink for each query and output."""

    def __init__(self, root: str, fmt: str = "parquet", before_commit: Callable[[int], None] | None = None):
        self.root, self.fmt, self.before_commit = root.rstrip("/"), fmt, before_commit

    def is_committed(self, spark: SparkSession, batch: int) -> bool:
        return exists(spark, f"{self.root}/commits/{batch:020d}")

    def write(self, df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        if self.is_committed(spark, batch):
            return
        attempt = f"{batch:020d}-{uuid.uuid4().hex}"
        df.write.format(self.fmt).save(f"{self.root}/data/_attempt={attempt}")
        if self.before_commit is not None:
            self.before_commit(batch)
        publish_once(spark, f"{self.root}/commits/{batch:020d}", f"{batch}\t{attempt}\n")

    def read(self, spark: SparkSession, schema: T.StructType | str) -> DataFrame:
        """The rows of committed batches. Attempts that never were committed are pruned by their folder."""
        if not exists(spark, f"{self.root}/commits"):
            return spark.createDataFrame([], schema)
        done = spark.read.text(f"{self.root}/commits").select(F.split_part("value", F.lit("\t"), F.lit(2)).alias("_attempt"))
        wanted = spark.createDataFrame([], schema).schema
        rows = spark.read.format(self.fmt).schema(T.StructType([*wanted.fields, T.StructField("_attempt", T.StringType())])).load(f"{self.root}/data")
        return rows.join(done, "_attempt", "left_semi").select(*wanted.names)
