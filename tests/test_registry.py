"""The registry is consistent and cheap queries agree with their oracles."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, norm

SAMPLE = ("P3_content_preview", "P14_redact_documents", "P28_canonical_url", "W6_chain_3step", "W1_ordered_events",
          "W12_upsert", "J3_late_failure", "A1_indicators_documents", "F1_contract_violations")


def test_keys():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 70


def test_entry(spark):
    assert {"rule_id", "severity", "findings"} == set(entry(spark).columns)


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    rel = con.sql(oracle_sql()[name])
    df = queries()[name](spark, sf_dir)
    cols = sorted(rel.columns)
    assert sorted(df.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_queries_are_listed_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 70 and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0


def test_json_documents_use_all_cores(spark, sf_dir):
    """The table is one row group; the work per document must not stay in one task."""
    out = queries()["P16_json_documents"](spark, sf_dir)
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    sizes = out.rdd.glom().map(len).collect()
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)
