"""Queries of reading, writing and control analyses against their SQL, and the cases around them."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, compare
from sigloom.plans import storage
from sigloom.sources import listing

SF = Path("/root/testdata/sf0.001")
NAMES = (
    "edf_units", "broken_recordings", "slow_spectrum", "listing_scan", "prediction_file", "diagnostic_oof", "fold_areas", "unseen_stratum",
    "permuted_within", "channel_halves", "behaviour_table",
)


@pytest.mark.skipif(not SF.is_dir(), reason="driver tables absent")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, str(SF)).toPandas()
    assert len(got) and compare(got, con.execute(entry.oracle_sql()[name]).df()) == "ok"


def test_listing_pages(spark):
    one = "<ListBucketResult><Name>b</Name><Contents><Key>A/s1/x &amp; y.edf</Key><Size>7</Size></Contents></ListBucketResult>"
    two = "<ListBucketResult>" + "".join(f"<Contents><Key>A/s{i}/x.edf</Key><Size>{i}</Size></Contents>" for i in (2, 3)) + "</ListBucketResult>"
    pages = spark.createDataFrame([(one,), (two,), ("<ListBucketResult><Name>b</Name></ListBucketResult>",), (None,)], "xml string")
    rows = sorted((r["key"], r["size"]) for r in listing.parse_listing(pages).collect())
    assert rows == [("A/s1/x & y.edf", 7), ("A/s2/x.edf", 2), ("A/s3/x.edf", 3)]
    assert listing.parse_listing(pages.limit(0)).count() == 0


def test_working_folders_are_shared_and_new(spark):
    a, b = (storage.working_folder(spark, "kind") for _ in range(2))
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_no_unit_no_reading(spark):
    from pyspark.sql import functions as F

    from sigloom.plans.registry import Tables
    from sigloom.sources import edf

    files = storage.files(Tables(spark, str(SF)))
    at, width = storage.UNITS_AT, 8 * storage.SIGNALS
    odd = files.withColumn("content", F.concat(F.substring("content", 1, at), F.lit("ohm".ljust(8) * storage.SIGNALS).cast("binary"), F.expr(f"substring(content, {at + width + 1})")))
    said = {(r["status"], "ohm" in (r["error"] or "")) for r in edf.headers(odd).select("status", "error").collect()}
    assert said == {("error", True)}


def test_fold_areas_compute_their_rows_once(spark):
    from pyspark.sql import functions as F

    from sigloom.operators import evaluation, nested

    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(v: pd.Series) -> pd.Series:
        seen.add(len(v))
        return v.astype(float)

    ids = spark.range(120).select(F.col("id").alias("row"), (F.col("id") % 12).alias("grp"), (F.col("id") % 3 % 2).cast("int").alias("y"))
    rows = ids.withColumn("stratum", F.when(F.col("y") == 1, "ptsd").otherwise("control_A")).withColumn("log_words", counted("row"))
    protocol = nested.Protocol("single", {"words": ("log_words",)}, (nested.Candidate(1.0, "control+somatoform", "words"),), calibrate=False)
    out = evaluation.fold_aucs(rows, protocol, {"a": ("control_A",)}, n_splits=2, n_repeats=2)
    assert out.count() == 4 and seen.value == 120
