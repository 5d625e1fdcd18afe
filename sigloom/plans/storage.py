"""Queries on what is read and written: units, broken recordings, stored spectra, listings, prediction files, slow spectra."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators import diagnostics, features, learn, recordings, spectra_cache, spectral
from sigloom.plans.learning import ALL_SQL, FIXED, described
from sigloom.plans.recordings import DIGITAL_SQL, FLAGS_SQL, UV, files, filtered_sql, windowed_sql
from sigloom.plans.registry import Tables, query
from sigloom.session import checkpointed
from sigloom.sources import edf, listing

UNITS = ("uV", "mV", "V")
SIGNALS = len(edf.CHANNELS)
# labels of 16 and transducers of 80 bytes a signal stand before the units of 8 bytes
UNITS_AT = edf.BLOCK + SIGNALS * (16 + 80)
HEADER_BYTES = edf.BLOCK * (SIGNALS + 1)


def working_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``; a local one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="sigloom-")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def number() -> Column:
    return F.regexp_extract("path", r"(\d+)$", 1).cast("long")


def _factor_sql() -> str:
    return "CASE s.rec % 3 " + " ".join(f"WHEN {i} THEN CAST({edf.UNIT_UV[u.lower()]} AS DOUBLE)" for i, u in enumerate(UNITS)) + " END"


@query(
    DIGITAL_SQL + f"""SELECT 'rec-' || s.rec AS path, channel, CASE s.rec % 3 WHEN 0 THEN 'uV' WHEN 1 THEN 'mV' ELSE 'V' END AS physical_dim,
round(max({_factor_sql()}) * (CAST(1600 AS DOUBLE) / 65535), 3) AS quant_step_uv, round(avg({_factor_sql()} * ({UV})), 2) + 0.0 AS mean_uv FROM s GROUP BY s.rec, channel"""
)
def edf_units(t: Tables) -> DataFrame:
    """Recordings whose headers name microvolts, millivolts or volts, all read as microvolts."""
    field = F.element_at(F.array(*[F.lit(u.ljust(8) * SIGNALS) for u in UNITS]), (number() % 3 + 1).cast("int")).cast("binary")
    head, rest = F.substring("content", 1, UNITS_AT), F.expr(f"substring(content, {UNITS_AT + 8 * SIGNALS + 1})")
    named = files(t).withColumn("content", F.concat(head, field, rest))
    total = F.aggregate(edf.microvolts(), F.lit(0.0), lambda a, v: a + v)
    s = edf.samples(named, per_piece=1000).select("path", "channel", total.alias("v"), F.size("digital").alias("n"))
    mean = s.groupBy("path", "channel").agg((F.sum("v") / F.sum("n")).alias("mean_uv"))
    return mean.join(edf.headers(named).select("path", "physical_dim", "quant_step_uv"), "path").select(
        "path", "channel", "physical_dim", F.round("quant_step_uv", 3).alias("quant_step_uv"), (F.round("mean_uv", 2) + F.lit(0.0)).alias("mean_uv")
    )


@query(
    DIGITAL_SQL + """, n1 AS (SELECT rec, max(used) AS used FROM s GROUP BY rec),
bad AS (SELECT rec, count(*) AS n FROM n1 CROSS JOIN LATERAL (SELECT unnest(range(0, (used + 999) // 1000)) AS k) WHERE rec % 2 = 1 AND least((k + 1) * 1000, used) > used // 125 // 2 * 125 GROUP BY rec)
SELECT 'rec-' || n1.rec AS path, CASE WHEN bad.n IS NULL THEN 'ok' ELSE 'error' END AS status, coalesce(bad.n, 0) AS broken_pieces,
  CAST(CASE WHEN bad.n IS NULL AND used >= 500 THEN (used - 500) // 250 + 1 ELSE 0 END AS BIGINT) AS n_windows FROM n1 LEFT JOIN bad ON bad.rec = n1.rec"""
)
def broken_recordings(t: Tables) -> DataFrame:
    """Every second file ends in the middle of its samples: its pieces are listed, it gives no window, and the others are whole."""
    whole = F.floor((F.col("file_bytes") - HEADER_BYTES) / (2 * 125 * SIGNALS))
    kept = F.when(number() % 2 == 1, HEADER_BYTES + F.floor(whole / 2) * (2 * 125 * SIGNALS) + 700).otherwise(F.col("file_bytes")).cast("int")
    cut = files(t).withColumn("content", F.substring("content", F.lit(1), kept))
    known = recordings.outline(cut, per_piece=1000)
    bad = known.quarantine.groupBy("path").agg(F.count(F.lit(1)).alias("broken_pieces"))
    w = recordings.conditioned_windows(cut, known=known, values=False).groupBy("path").agg(F.countDistinct("window_idx").alias("n_windows"))
    out = cut.select("path").join(bad, "path", "left").join(w, "path", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("path", F.when(F.col("broken_pieces").isNull(), "ok").otherwise("error").alias("status"), zero("broken_pieces"), zero("n_windows"))


ALPHA_BINS = (32, 52)


@query(
    filtered_sql(None, 40.0) + windowed_sql(500, 250) + FLAGS_SQL + f""", good AS (SELECT c.rec, c.channel, c.k, i, (c.v - (a + b * i)) * (0.5 - 0.5 * cos(2 * pi() * i / 500)) AS v
  FROM cut c JOIN fit ON c.rec = fit.rec AND c.channel = fit.channel AND c.k = fit.k JOIN f ON c.rec = f.rec AND c.channel = f.channel AND c.k = f.k WHERE f.reject = 0),
dft AS (SELECT rec, channel, k, bin, sum(v * cos(2 * pi() * ((bin * i) % 500) / 500)) AS re, sum(v * sin(2 * pi() * ((bin * i) % 500) / 500)) AS im FROM good CROSS JOIN range({ALPHA_BINS[0]}, {ALPHA_BINS[1] + 1}) r(bin) GROUP BY ALL)
SELECT 'rec-' || rec AS path, channel, CAST(count(DISTINCT k) AS BIGINT) AS n_good, CAST(bin AS INTEGER) AS bin, round(avg(log10(2 * (re * re + im * im) / (125 * 187.5))) + {spectral.LOG10_BIAS!r}, 5) + 0.0 AS log10_psd FROM dft GROUP BY rec, channel, bin"""
)
def stored_spectra(t: Tables) -> DataFrame:
    """Alpha range of the spectra table, filled in two runs: the second one reads the samples of contents that the first has not seen."""
    have = files(t)
    known = edf.headers(have).select("path", "status").join(edf.content_hashes(edf.channel_digests(have)), "path")
    registry = checkpointed(known).join(have, "path")
    folder = working_folder(t.spark, "spectra")
    spectra_cache.update(registry.filter(number() % 2 == 0), folder)
    table = spectra_cache.update(registry, folder)
    cells = table.filter("n_good > 0").join(registry.select("path", "content_hash"), "content_hash").select("path", "channel", "n_good", F.posexplode("spectrum").alias("bin", "v"))
    return cells.filter(F.col("bin").between(*ALPHA_BINS)).select("path", "channel", "n_good", "bin", (F.round(F.log10("v"), 5) + F.lit(0.0)).alias("log10_psd"))


SLOW_HZ = 6.5
# fixed value: objects in one page of a listing
LISTING_PAGE = 1000


@query(
    DIGITAL_SQL + f""", xs AS (SELECT rec, channel, t, {UV} AS v, used FROM s WHERE channel IN ('Fp1', 'Fp2')),
cut AS (SELECT rec, channel, k, t - k * 1000 AS i, v FROM (SELECT *, unnest(range(greatest(0, (t - 1000) // 1000), t // 1000 + 1)) AS k FROM xs) WHERE k * 1000 + 2000 <= used AND t >= k * 1000 AND t < k * 1000 + 2000),
m AS (SELECT rec, channel, k, avg(v) AS m FROM cut GROUP BY ALL),
tapered AS (SELECT c.rec, c.channel, c.k, i, (v - m) * (0.5 - 0.5 * cos(2 * pi() * i / 2000)) AS v FROM cut c JOIN m ON c.rec = m.rec AND c.channel = m.channel AND c.k = m.k),
dft AS (SELECT rec, channel, k, bin, sum(v * cos(2 * pi() * ((bin * i) % 2000) / 2000)) AS re, sum(v * sin(2 * pi() * ((bin * i) % 2000) / 2000)) AS im FROM tapered CROSS JOIN range(0, {int(SLOW_HZ * 16) + 1}) r(bin) GROUP BY ALL),
mid AS (SELECT rec, channel, bin, quantile_cont(CASE WHEN bin = 0 THEN 1 ELSE 2 END * (re * re + im * im) / (125 * 750.0), 0.5) AS v, count(*) AS n FROM dft GROUP BY ALL)
SELECT 'rec-' || rec AS path, bin / CAST(16 AS DOUBLE) AS freq, round(log10(avg(v / (1 + coalesce(list_sum(list_transform(range(1, (n - 1) // 2 + 1), lambda i: 1 / CAST(2 * i + 1 AS DOUBLE) - 1 / CAST(2 * i AS DOUBLE))), 0)))), 5) + 0.0 AS log10_psd FROM mid GROUP BY rec, bin"""
)
def slow_spectrum(t: Tables) -> DataFrame:
    """Median-averaged spectrum of the frontal channels below 6.5 Hz, from 16-s segments."""
    out = diagnostics.lowfreq_spectrum(files(t)).filter(F.col("freq") <= SLOW_HZ)
    return out.select("path", "freq", (F.round(F.log10("psd"), 5) + F.lit(0.0)).alias("log10_psd"))


@query(
    """WITH l AS (SELECT page_id, length(html) AS size, string_split(string_split(url, '//')[2], '/')[2] AS grp, string_split(string_split(url, '//')[2], '/')[1] AS subject FROM pages),
r AS (SELECT *, dense_rank() OVER (PARTITION BY grp ORDER BY subject) AS k FROM l)
SELECT grp || '/' || subject || '/page & ' || page_id || '.edf' AS key, CAST(size AS BIGINT) AS size, grp AS "group", subject FROM r WHERE k <= 3 AND page_id % 4 <> 0"""
)
def listing_scan(t: Tables) -> DataFrame:
    """Pages of a bucket listing in XML: the first three subjects of each group, less the files that are there in the same size."""
    place = F.split(F.get(F.split("url", "//"), 1), "/")
    key = F.concat(place[1], F.lit("/"), place[0], F.lit("/page & "), F.col("page_id").cast("string"), F.lit(".edf"))
    rows = t.pages.select("page_id", key.alias("key"), F.length("html").cast("long").alias("size"))
    entry = F.concat(F.lit("<Contents><Key>"), F.replace("key", F.lit("&"), F.lit("&amp;")), F.lit("</Key><Size>"), F.col("size").cast("string"), F.lit("</Size></Contents>"))
    page = F.concat(F.lit("<ListBucketResult><Name>pages</Name>"), F.array_join(F.collect_list(entry), ""), F.lit("</ListBucketResult>"))
    pages = rows.groupBy(F.floor(F.col("page_id") / LISTING_PAGE)).agg(page.alias("xml"))
    chosen = listing.select_files(listing.parse_listing(pages), limit_subjects=3)
    present = rows.filter("page_id % 4 = 0").select("key", "size")
    return listing.missing_or_changed(chosen, present).select("key", "size", "group", "subject")


@query(
    ALL_SQL + """, z AS (SELECT doc_id, 0.8 * (coalesce(log_chars, 6) - 6.5) / 1.5 - 0.3 * (log_words - 4.5) / 1.25 + 0.25 AS v FROM f)
SELECT 'doc-' || doc_id || ',' || CAST(round(1 / (1 + exp(-(0.7 * v + 0.2))), 4) AS VARCHAR) AS line FROM z UNION ALL SELECT 'subject_id,ptsd_probability'"""
)
def prediction_file(t: Tables) -> DataFrame:
    """Lines of the prediction file: a stored model is loaded, scores every document, and the one file is read back."""
    model = learn.LogisticModel.from_json(FIXED.to_json())
    rows = described(t).withColumn("subject_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    scored = features.score(rows, model).withColumn("ptsd_probability", F.round("ptsd_probability", 4))
    path = working_folder(t.spark, "predictions") + ".csv"
    features.write_predictions(scored, path)
    lines = t.spark.read.option("lineSep", "\r\n").text(path)
    return lines.select(F.regexp_replace("value", "^\ufeff", "").alias("line"))
