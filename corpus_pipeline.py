"""From raw documents to packed token sequences: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actiontrail.llm import decontaminate, line_dedup, packing, quality, set_join
from actiontrail.llm.shared import saved


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the trees reject go."""
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).where("kept").select(*docs.columns)


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType)).select(*like.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; the text and its length follow."""
    return _counted(line_dedup.dedup(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays."""
    return set_join.first_of_classes(docs).select(*docs.columns)


def benchmark_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts; documents that were nothing else go."""
    found = decontaminate.search(docs, _table(spark, sf_dir, "benchmark"))
    return _counted(decontaminate.without_spans(found), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequences and places."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", drop_lines), ("near_duplicates", near_duplicates),
          ("decontamination", benchmark_spans), ("best_fit_packing", pack_sequences)]

# The quality stage is a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
