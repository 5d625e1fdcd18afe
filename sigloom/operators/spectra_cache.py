"""Incremental table of record spectra, addressed by content.

A row belongs to (digest of the samples, digest of the conditioning, channel). A run reads what is there, computes only the contents that
are missing, and adds them as one batch: a folder that counts once its writer has left the success mark. Batches are never changed, so
readers see committed ones whatever happens to a writer; two writers of one content store equal rows, read once.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators import features, recordings, spectral
from sigloom.operators.fingerprint import keep_first
from sigloom.sinks.single_file import _system

# to be raised whenever spectra of the same settings change
VERSION = 1
SCHEMA = "content_hash string, conditioning string, channel string, n_good long, spectrum array<double>"


def conditioning_digest(cfg: recordings.Conditioning) -> str:
    return hashlib.sha256(f"{VERSION}:{cfg!r}".encode()).hexdigest()


def committed(spark: SparkSession, folder: str) -> list[str]:
    """Batches of the table that are complete."""
    _, place, fs = _system(spark, folder)
    if not fs.exists(place):
        return []
    found = [s.getPath() for s in fs.listStatus(place) if s.isDirectory()]
    return sorted(p.toString() for p in found if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read(spark: SparkSession, folder: str, cfg: recordings.Conditioning | None = None) -> DataFrame:
    """Spectra of all committed batches, of one conditioning if given."""
    batches = committed(spark, folder)
    rows = spark.read.schema(SCHEMA).parquet(*batches) if batches else spark.createDataFrame([], SCHEMA)
    rows = rows if cfg is None else rows.filter(F.col("conditioning") == conditioning_digest(cfg))
    return rows.dropDuplicates(["content_hash", "conditioning", "channel"])


def record_spectra(files: DataFrame, cfg: recordings.Conditioning) -> DataFrame:
    """Corrected geometric mean spectrum and number of retained windows per (path, channel)."""
    flagged = recordings.flagged_windows(files, cfg)
    good = flagged.groupBy("path", "channel").agg(F.count_if(F.col("reject") == 0).alias("n_good"))
    spectra = spectral.log_mean_spectrum(features.with_psd(flagged, cfg.rate_hz), ["path", "channel"])
    return good.join(spectra, ["path", "channel"], "left")


def missing(registry: DataFrame, folder: str, cfg: recordings.Conditioning) -> DataFrame:
    """One readable file (``content_hash, path, file_bytes`` and ``content`` where given) per content that the table lacks."""
    have = read(registry.sparkSession, folder, cfg).select("content_hash").distinct()
    carried = ["content_hash", "path", "file_bytes", *(["content"] if "content" in registry.columns else [])]
    ok = registry.filter("status = 'ok' AND content_hash IS NOT NULL").select(carried)
    return keep_first(ok.join(have, "content_hash", "left_anti"), "content_hash", "path").select(carried)


def update(registry: DataFrame, folder: str, cfg: recordings.Conditioning = recordings.Conditioning()) -> DataFrame:
    """Adds the missing contents as one batch and returns the spectra of the registry's contents."""
    todo = missing(registry, folder, cfg)
    if not todo.isEmpty():
        made = record_spectra(todo.drop("content_hash"), cfg).join(todo.select("path", "content_hash"), "path")
        made = made.select("content_hash", F.lit(conditioning_digest(cfg)).alias("conditioning"), "channel", "n_good", "spectrum")
        made.write.parquet(f"{folder}/batch-{uuid.uuid4().hex}")
    wanted = registry.filter("status = 'ok'").select("content_hash").distinct()
    return read(registry.sparkSession, folder, cfg).join(wanted, "content_hash", "left_semi")
