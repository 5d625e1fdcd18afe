"""Every SQL twin belongs to a query, and a sample of pairs agrees on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, compare

SF = Path("/root/testdata/sf0.001")
SAMPLE = ("auc_rank", "true_runs", "sliding_windows", "reject_bitmask", "content_hash_dups", "hann_psd", "linear_score", "permute_labels", "half_correlation", "edf_decode")


def test_sql_texts_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 90


@pytest.mark.skipif(not SF.is_dir(), reason="driver tables absent")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, str(SF)).toPandas()
    assert compare(got, con.execute(entry.oracle_sql()[name]).df()) == "ok"


def test_queries_can_be_listed_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.queries()) >= 90, bool(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == ["True", "True"], said.stderr[-500:]
