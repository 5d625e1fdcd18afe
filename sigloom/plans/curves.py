"""Element-wise statistics and causal filters of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions import signal
from sigloom.operators import arrays, longfilter
from sigloom.plans.registry import Tables, query, r6

CELLS = "WITH c AS (SELECT label, i - 1 AS place, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings CROSS JOIN range(1, 65) r(i)) "
GAIN, FEED = (float(x.real) for x in signal._digital_poles(125.0, 1, 0.5)[0])


@query(CELLS + "SELECT label, CAST(place AS INTEGER) AS place, CAST(count(v) AS BIGINT) AS n, round(avg(v), 6) + 0.0 AS mean, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem FROM c GROUP BY label, place")
def curve_sem(t: Tables) -> DataFrame:
    """Mean curve with standard error per label."""
    rows = arrays.mean_sem(t.embeddings, ["label"], "embedding")
    cells = rows.select("label", "n", "sem", F.posexplode("mean").alias("place", "m"))
    return cells.select("label", "place", F.get("n", F.col("place")).alias("n"), r6("m").alias("mean"), r6(F.get("sem", F.col("place"))).alias("sem"))


MEDIAN_SQL = CELLS + "SELECT label, CAST(place AS INTEGER) AS place, round(quantile_cont(v, 0.5), 6) + 0.0 AS median FROM c GROUP BY label, place"


def _medians(t: Tables, small_rows: int) -> DataFrame:
    rows = arrays.median(t.embeddings, ["label"], "embedding", small_rows)
    return rows.select("label", F.posexplode("median").alias("place", "m")).select("label", "place", r6("m").alias("median"))


@query(MEDIAN_SQL)
def median_curve(t: Tables) -> DataFrame:
    """Median of every position per label."""
    return _medians(t, arrays.SMALL_ROWS)


@query(MEDIAN_SQL)
def median_curve_refined(t: Tables) -> DataFrame:
    """The same by counting refinement, as for keys of any size."""
    return _medians(t, 0)


@query(
    f"""WITH s AS (SELECT vec_id, vec_id // 8 AS rec, (vec_id % 8) * 64 + i - 1 AS pos, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings CROSS JOIN range(1, 65) r(i)),
u AS (SELECT *, {GAIN!r} * (x - coalesce(lag(x) OVER (PARTITION BY rec ORDER BY pos), 0)) AS u, row_number() OVER (PARTITION BY rec ORDER BY pos) AS k FROM s),
y AS (SELECT vec_id, pos, pow({FEED!r}, k) * sum(u / pow({FEED!r}, k)) OVER (PARTITION BY rec ORDER BY pos) AS y FROM u)
SELECT vec_id, round(sum(y), 5) + 0.0 AS total, round(arg_max(y, pos), 5) + 0.0 AS last, round(sum(y * (pos % 64)), 4) + 0.0 AS moment FROM y GROUP BY vec_id"""
)
def highpass_pieces(t: Tables) -> DataFrame:
    """Causal high-pass over signals of eight vectors each, filtered in pieces of one vector."""
    rows = t.embeddings.select("vec_id", F.floor(F.col("vec_id") / 8).alias("rec"), "embedding")
    out = longfilter.highpass_pieces(rows, ["rec"], "vec_id", "embedding", 125.0, 1, 0.5)
    total = F.aggregate("filtered", F.lit(0.0), lambda a, v: a + v)
    places = F.transform("filtered", lambda v, i: v * i)
    moment = F.aggregate(places, F.lit(0.0), lambda a, v: a + v)
    rounded = lambda c, k: F.round(c, k) + F.lit(0.0)
    return out.select("vec_id", rounded(total, 5).alias("total"), rounded(F.element_at("filtered", -1), 5).alias("last"), rounded(moment, 4).alias("moment"))
