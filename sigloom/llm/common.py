"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARROW_ROWS = 500
SORT_ROWS = 200_000


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="sigloom-llm-")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path below the folder that the cluster names in ``spark.checkpoint.dir``; a local one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.sparkContext.getCheckpointDir() or _own_folder()
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, kind: str = "step") -> DataFrame:
    """Write a table once to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Few whole texts per Arrow batch, so that a batch of very long ones still fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def whole_text(name: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def salts_for(largest: int) -> int:
    """How far to spread the rows of a value so that none of its parts passes about ``SORT_ROWS`` of them."""
    return max(64, -(-largest // SORT_ROWS))


def ranked_within(df: DataFrame, value: str, order: list[str], salts: int = 64) -> DataFrame:
    """Adds ``_rank`` from 0 within ``value``; a frequent value is spread by a salt."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(value, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(value).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(value, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(value, "_salt").orderBy(*order)) - 1
    return salted.withColumn("_local", local).join(sizes, [value, "_salt"]).withColumn("_rank", F.col("_local") + F.col("_before")).drop("_salt", "_local", "_before")
