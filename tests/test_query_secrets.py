"""Texts with secrets that the tables at sf0.01 do not hold: queries equal their SQL, and the default redaction masks them all."""

import os
import shutil
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from actiontrail.functions.redact import redact_text

HEX = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"
TEXTS = (f'a TOKEN = "{HEX.upper()}"!! b@mail.example.com', f'a token = "{HEX}" c 8.8.8.8', f"password={HEX} mail d@mail.example.com",
         f'Token="{HEX}"', f'token\t=\n"{HEX}" token = "{HEX[:-1]}"', None, "")


@pytest.fixture(scope="module")
def tables(sf_dir):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name in ("pages", "conversations"):
        shutil.copy(f"{sf_dir}/{name}.parquet", root)
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?)", list(enumerate(TEXTS)))
    con.execute(f"COPY d TO '{root}/documents.parquet' (FORMAT parquet)")
    return root


def compared(spark, root, name):
    con = duckdb.connect()
    for file in os.listdir(root):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{root}/{file}')")
    want = con.sql(oracle_sql()[name])
    columns = want.columns
    got = queries()[name](spark, root).select(*columns).collect()
    return sorted(map(repr, (tuple(r) for r in got))), sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("name", ["A1_indicators_documents", "O2_O4_indicator_caps", "O4_run_cap", "P14_redact_documents"])
def test_queries_equal_their_sql(spark, tables, name):
    got, want = compared(spark, tables, name)
    assert got == want and got


def test_default_redaction_masks_them_all(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS[:4]], "t string").select(redact_text(F.col("t")).alias("t")).collect()
    assert all(HEX not in r.t.lower() and "[redacted]" in r.t for r in rows)
