"""Small files that appear whole, once, and never replace another: what makes a finished folder visible."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _file(spark: SparkSession, path: str):
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name, name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    name, fs = _file(spark, path)
    return fs.exists(name)


def publish_once(spark: SparkSession, path: str, text: str) -> None:
    """Writes a draft beside and renames it; raises FileExistsError where the name is taken."""
    final, fs = _file(spark, path)
    draft, _ = _file(spark, f"{path.rsplit('/', 1)[0]}/_draft-{uuid.uuid4().hex}")
    fs.mkdirs(final.getParent())
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
