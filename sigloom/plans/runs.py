"""Run-length and mask queries on the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.functions.numeric import whole_seconds_since
from sigloom.operators import ordered, runs
from sigloom.plans.registry import Tables, query

RUNS_SQL = """
WITH o AS (SELECT user_id, event_type, ts, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events),
r AS (SELECT user_id, event_type, g, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM o GROUP BY user_id, event_type, g),
q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start) AS run, row_number() OVER (PARTITION BY user_id ORDER BY start DESC) AS back FROM r)
"""


def event_runs(t: Tables) -> DataFrame:
    return runs.true_runs(t.events, ["user_id"], ["ts", "event_id"], "event_type")


@query(RUNS_SQL + 'SELECT user_id, CAST(run AS BIGINT) AS run, event_type, start, "end", CAST(n AS BIGINT) AS n FROM q')
def true_runs(t: Tables) -> DataFrame:
    return event_runs(t).select("user_id", F.col("run").cast("long").alias("run"), "event_type", "start", "end", "n")


@query(
    RUNS_SQL + """SELECT user_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN n >= 2 THEN n ELSE 0 END) AS BIGINT) AS constant,
  CAST(count(*) FILTER (WHERE n >= 2) AS BIGINT) AS n_stretches FROM q GROUP BY user_id"""
)
def constant_stretch(t: Tables) -> DataFrame:
    return runs.edge_runs(event_runs(t), ["user_id"], "event_type", 2).select("user_id", "n", "constant", "n_stretches")


@query(
    RUNS_SQL + """SELECT user_id, CAST(max(CASE WHEN run = 1 AND n >= 2 THEN n ELSE 0 END) AS BIGINT) AS head,
  CAST(max(CASE WHEN back = 1 AND n >= 2 THEN n ELSE 0 END) AS BIGINT) AS tail,
  CAST(sum(n) - max(CASE WHEN run = 1 AND n >= 2 THEN n ELSE 0 END) - max(CASE WHEN back = 1 AND n >= 2 THEN n ELSE 0 END) AS BIGINT) AS active
  FROM q GROUP BY user_id"""
)
def edge_constant(t: Tables) -> DataFrame:
    out = runs.edge_runs(event_runs(t), ["user_id"], "event_type", 2)
    return out.select("user_id", "head", "tail", (F.col("n") - F.col("head") - F.col("tail")).alias("active"))


@query(
    """
WITH q AS (SELECT quantile_cont(value, 0.75) AS cut FROM events),
o AS (SELECT user_id, ts, event_id, value >= cut AS rail FROM events, q),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, rail ORDER BY ts, event_id) AS g FROM o),
r AS (SELECT user_id, rail, g, count(*) AS n FROM k GROUP BY user_id, rail, g)
SELECT user_id, CAST(coalesce(sum(n) FILTER (WHERE rail AND n >= 3), 0) AS BIGINT) AS rail_samples,
       CAST(count(*) FILTER (WHERE rail AND n >= 3) AS BIGINT) AS rail_runs FROM r GROUP BY user_id
"""
)
def rail_runs(t: Tables) -> DataFrame:
    cut = ordered.quantiles(t.events, [], "value", {"cut": 0.75})
    rows = t.events.select("user_id", "ts", "event_id", "value").crossJoin(F.broadcast(cut))  # one number
    found = runs.true_runs(rows.withColumn("rail", F.col("value") >= F.col("cut")), ["user_id"], ["ts", "event_id"], "rail")
    hit = F.col("rail") & (F.col("n") >= 3)
    return found.groupBy("user_id").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("rail_samples"), F.count_if(hit).alias("rail_runs")
    )


@query(
    """
SELECT event_id, coalesce(max(CASE WHEN value > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) = 1 AS near_spike
FROM events
"""
)
def dilate_mask(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "ts", "event_id", "value")
    out = runs.dilate(rows, ["user_id"], ["ts", "event_id"], F.col("value") > 120, 2, "near_spike")
    return out.select("event_id", "near_spike")


@query(
    """
WITH o AS (SELECT epoch(date_trunc('day', min(ts))) AS first FROM events), e AS (SELECT event_type, CAST(floor(epoch(ts) - first) AS BIGINT) AS s, value FROM events, o),
w AS (SELECT event_type, k FROM (SELECT DISTINCT event_type FROM e) CROSS JOIN (SELECT unnest(range(0, (max(s) + 1800) // 7200 + 1)) AS k FROM e)),
b AS (SELECT event_type, s - 1800 AS a, s + 1800 AS z FROM e WHERE value > 150)
SELECT w.event_type, CAST(w.k AS BIGINT) AS window_idx, CAST(count(*) AS BIGINT) AS n_bad
FROM w JOIN b ON w.event_type = b.event_type AND b.z >= w.k * 7200 AND b.a < w.k * 7200 + 14400
GROUP BY w.event_type, w.k
"""
)
def mask_to_windows(t: Tables) -> DataFrame:
    # seconds from the first day of the table (one number); 4-hour windows every 2 hours; half-hour guard around spikes
    first = t.events.agg((F.datediff(F.to_date(F.min("ts")), F.lit("1970-01-01").cast("date")).cast("long") * 86400).alias("first"))
    second = whole_seconds_since(F.col("ts"), "1970-01-01") - F.col("first")
    bad = t.events.filter(F.col("value") > 150).crossJoin(F.broadcast(first)).select("event_type", second.alias("s"))
    idx = runs.overlapping_windows(F.col("s") - 1800, F.col("s") + 1800, 14400, 7200)
    return (
        bad.select("event_type", F.explode(idx).alias("window_idx"))
        .groupBy("event_type", "window_idx")
        .agg(F.count(F.lit(1)).alias("n_bad"))
    )
