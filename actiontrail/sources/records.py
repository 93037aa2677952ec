"""Typed record streams: reading, writing, fan-out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from actiontrail.schema import EVENT_SCHEMA, conform

ENDPOINT = T.StructType([T.StructField(n, T.StringType()) for n in
                         ("hostname", "os", "arch", "username", "uid", "device_id")])
ENVELOPE = T.StructType([
    T.StructField("record_type", T.StringType()), T.StructField("run_id", T.StringType()),
    T.StructField("endpoint", ENDPOINT)])
BAD = "_bad"
ENVELOPE_COLUMNS = ["record_type", "run_id", "endpoint"]


def read_records(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """`(records, bad_lines)` of newline-delimited JSON; bad lines are kept."""
    full = T.StructType([*ENVELOPE.fields, *schema.fields, T.StructField(BAD, T.StringType())])
    raw = (spark.read.schema(full).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", BAD).json(path))
    # A bad line must be told from a good one before columns are pruned.
    good = raw.where(F.col(BAD).isNull() & F.col("record_type").isNotNull())
    bad = raw.where(F.col(BAD).isNotNull() | F.col("record_type").isNull())
    return good.drop(BAD), bad.select(BAD, F.col("_metadata.file_path").alias("path"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    good, _ = read_records(spark, path)
    return conform(good.where(F.col("record_type") == "event"))


def envelope(df: DataFrame, record_type: str, run_id: str, endpoint: Column | None = None) -> DataFrame:
    host = endpoint if endpoint is not None else F.lit(None).cast(ENDPOINT)
    return df.select(F.lit(record_type).alias("record_type"), F.lit(run_id).alias("run_id"),
                     host.alias("endpoint"), "*")


# The kinds of record a run can emit.
KINDS = ("event", "finding", "decision", "indicator", "diagnostic", "summary")


def select_kinds(records: DataFrame, kinds: Iterable[str] | None = None) -> DataFrame:
    """The records of the chosen kinds; all without a choice. A summary always stays, as it closes a run."""
    if kinds is None:
        return records
    chosen = {k.strip() for k in kinds}
    unknown = chosen - set(KINDS)
    if unknown or not chosen:
        raise ValueError(f"unknown record kinds {sorted(unknown)}" if unknown else "no record kind is chosen")
    return records.where(F.col("record_type").isin(*sorted(chosen | {"summary"})))


def as_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row; null fields are omitted."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"),
                     F.col("record_type") if "record_type" in df.columns else F.lit("").alias("record_type"))


def write_records(df: DataFrame, path: str, fmt: str = "json", mode: str = "append") -> None:
    """Write enveloped records partitioned by record type."""
    df.write.mode(mode).partitionBy("record_type").format(fmt).save(path)


class FanOutError(RuntimeError):
    def __init__(self, failures: Mapping[str, BaseException]):
        super().__init__("; ".join(f"{k}: {v}" for k, v in failures.items()))
        self.failures = dict(failures)


def fan_out(df: DataFrame, sinks: Mapping[str, Callable[[DataFrame], None]]) -> None:
    """Write to every sink; a failing sink does not stop the others.

    The rows are persisted once so each sink reads the same result. An
    executor loss only recomputes the lost blocks.
    """
    failures: dict[str, BaseException] = {}
    df.persist()
    try:
        for name, write in sinks.items():
            try:
                write(df)
            except Exception as err:  # noqa: BLE001 - reported together below
                failures[name] = err
    finally:
        df.unpersist()
    if failures:
        raise FanOutError(failures)
