"""Bucket listings in XML: keys, sizes, and the choice of files to fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Key and size of every object in a saved listing."""
    rows = spark.read.format("xml").option("rowTag", "Contents").schema("Key string, Size long").load(path)
    return rows.select(F.col("Key").alias("key"), F.col("Size").alias("size"))


def parse_listing(pages: DataFrame, column: str = "xml") -> DataFrame:
    """Key and size of every object in listing pages held as text, one page of a bounded number of objects a row."""
    entries = F.from_xml(column, "Contents array<struct<Key: string, Size: bigint>>")["Contents"]
    return pages.select(F.explode(entries).alias("c")).select(F.col("c.Key").alias("key"), F.col("c.Size").alias("size"))


def select_files(listing: DataFrame, group: str | None = None, limit_subjects: int | None = None) -> DataFrame:
    """Keys of the form ``group/subject/file``, optionally of one group and of the first subjects per group in key order."""
    parts = F.split("key", "/")
    rows = listing.filter(F.size(parts) == 3).withColumns({"group": parts[0], "subject": parts[1]})
    if group is not None:
        rows = rows.filter(F.col("group") == group)
    if limit_subjects is None:
        return rows
    # the row_number limit is applied per group before the shuffle
    rank = F.row_number().over(Window.partitionBy("group").orderBy("subject"))
    chosen = rows.select("group", "subject").distinct().withColumn("_r", rank).filter(F.col("_r") <= limit_subjects).drop("_r")
    return rows.join(chosen, ["group", "subject"], "left_semi")


def missing_or_changed(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Files whose local copy is absent or of another size; both tables have ``key`` and ``size``."""
    return wanted.join(present, ["key", "size"], "left_anti")
