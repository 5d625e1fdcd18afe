"""Windowing, detrending and quality-flag queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.numeric import day_seconds
from sigloom.operators import ordered, windows
from sigloom.operators.windows import Reject
from sigloom.plans.registry import Tables, query, r6
from sigloom.streaming import event_windows


@query(
    """
WITH k AS (SELECT event_type, value, CAST(floor(epoch(ts) / 7200) AS BIGINT) AS i FROM events),
x AS (SELECT event_type, value, i - d AS i FROM k CROSS JOIN (VALUES (0), (1)) v(d))
SELECT event_type, make_timestamp(i * 7200 * 1000000) AS window_start, CAST(count(*) AS BIGINT) AS n,
       round(avg(value), 6) AS mean_value, round(coalesce(stddev_pop(value), 0), 6) + 0.0 AS sd_value
FROM x GROUP BY event_type, i
"""
)
def sliding_windows(t: Tables) -> DataFrame:
    out = event_windows.sliding(t.events)
    return out.select("event_type", "window_start", "n", r6("mean_value").alias("mean_value"), r6("sd_value").alias("sd_value"))


CYCLES_SQL = """
WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
c AS (SELECT user_id, CAST(floor(i / 8) AS BIGINT) AS cycle, count(*) AS n, max(value) - min(value) AS ptp FROM p GROUP BY 1, 2)
"""


@query(CYCLES_SQL + "SELECT user_id, cycle, CAST(n AS BIGINT) AS n, round(ptp, 6) AS ptp, ptp <= 150 AS good FROM c WHERE n = 8")
def tumbling_cycles(t: Tables) -> DataFrame:
    rows = windows.tumbling(t.events.select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], 8)
    ptp = F.max("value") - F.min("value")
    out = rows.groupBy("user_id", "cycle").agg(F.count(F.lit(1)).alias("n"), ptp.alias("ptp")).filter("n = 8")
    return out.select("user_id", "cycle", "n", r6("ptp").alias("ptp"), (F.col("ptp") <= 150).alias("good"))


@query(
    """
WITH e AS (SELECT event_id, event_type, date_trunc('day', ts) AS d, epoch(ts) - epoch(date_trunc('day', ts)) AS s, value FROM events),
f AS (SELECT event_type, d, regr_slope(value, s) AS b, regr_intercept(value, s) AS a FROM e GROUP BY event_type, d)
SELECT e.event_id, round(e.value - (f.a + f.b * e.s), 6) + 0.0 AS residual FROM e JOIN f ON e.event_type = f.event_type AND e.d = f.d
"""
)
def detrend(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "event_type", F.to_date("ts").alias("d"), day_seconds(F.col("ts")).alias("s"), "value")
    return windows.detrend(rows, ["event_type", "d"], "s", "value").select("event_id", r6("residual").alias("residual"))


@query(
    """
WITH e AS (SELECT event_id, event_type, round(ln(value + 1), 9) AS v FROM events),
m AS (SELECT event_type, quantile_cont(v, 0.5) AS med FROM e GROUP BY event_type),
d AS (SELECT e.event_type, quantile_cont(abs(v - med), 0.5) AS mad FROM e JOIN m ON e.event_type = m.event_type GROUP BY e.event_type)
SELECT e.event_type, CAST(count(*) FILTER (WHERE (v - med) / (1.4826 * mad) > 1.5) AS BIGINT) AS n_outliers, CAST(count(*) AS BIGINT) AS n,
       round(max(med), 6) AS med, round(max(mad), 6) AS mad
FROM e JOIN m ON e.event_type = m.event_type JOIN d ON e.event_type = d.event_type GROUP BY e.event_type
"""
)
def robust_z_flags(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "event_type", F.round(F.ln(F.col("value") + 1), 9).alias("v"))
    flagged = windows.robust_outliers(rows, ["event_type"], "v", "outlier", z=1.5)
    mid = ordered.median(rows, ["event_type"], "v", "med")
    mad = ordered.median(rows.join(mid, "event_type").withColumn("dev", F.abs(F.col("v") - F.col("med"))), ["event_type"], "dev", "mad")
    out = flagged.groupBy("event_type").agg(F.count_if("outlier").alias("n_outliers"), F.count(F.lit(1)).alias("n"))
    return out.join(mid, "event_type").join(mad, "event_type").select("event_type", "n_outliers", "n", r6("med").alias("med"), r6("mad").alias("mad"))


FLAGS_SQL = """
WITH w AS (SELECT event_type, date_trunc('day', ts) AS d, count(*) AS n, stddev_pop(value) AS sd, max(value) - min(value) AS ptp,
           max(value) AS top, round(ln(var_pop(value) + 1e-9), 9) AS lv FROM events GROUP BY 1, 2),
a AS (SELECT *, CASE WHEN sd < 35 THEN 1 ELSE 0 END + CASE WHEN top >= 330 THEN 2 ELSE 0 END + CASE WHEN n < 55 THEN 16 ELSE 0 END
             + CASE WHEN ptp > 300 THEN 4 ELSE 0 END AS f0 FROM w),
m AS (SELECT event_type, quantile_cont(lv, 0.5) AS med, count(*) AS ref FROM a WHERE f0 = 0 GROUP BY event_type),
s AS (SELECT a.event_type, quantile_cont(abs(lv - med), 0.5) AS mad FROM a JOIN m ON a.event_type = m.event_type WHERE f0 = 0 GROUP BY a.event_type),
f AS (SELECT a.*, f0 + CASE WHEN ref >= 5 AND mad > 0 AND (lv - med) / (1.4826 * mad) > 1.5 THEN 8 ELSE 0 END AS reject
      FROM a LEFT JOIN m ON a.event_type = m.event_type LEFT JOIN s ON a.event_type = s.event_type)
"""


def _flagged(t: Tables) -> DataFrame:
    v = F.col("value")
    w = t.events.groupBy("event_type", F.to_date("ts").alias("d")).agg(
        F.count(F.lit(1)).alias("n"),
        F.stddev_pop(v).alias("sd"),
        (F.max(v) - F.min(v)).alias("ptp"),
        F.max(v).alias("top"),
        F.round(F.ln(F.var_pop(v) + 1e-9), 9).alias("lv"),
    )
    first = (
        windows.flag(F.col("sd") < 35, Reject.FLAT)
        .bitwiseOR(windows.flag(F.col("top") >= 330, Reject.RAIL))
        .bitwiseOR(windows.flag(F.col("n") < 55, Reject.DROPOUT))
        .bitwiseOR(windows.flag(F.col("ptp") > 300, Reject.AMPLITUDE))
    )
    w = windows.robust_outliers(w.withColumn("f0", first), ["event_type"], "lv", "outlier", F.col("f0") == 0, z=1.5)
    return w.withColumn("reject", F.col("f0").bitwiseOR(windows.flag(F.col("outlier"), Reject.VARIANCE)))


@query(
    FLAGS_SQL + """SELECT event_type, d AS day, reject, CASE WHEN reject & 1 > 0 THEN 'flat' WHEN reject & 2 > 0 THEN 'rail' WHEN reject & 4 > 0 THEN 'amplitude'
  WHEN reject & 8 > 0 THEN 'variance' WHEN reject & 16 > 0 THEN 'dropout' ELSE 'ok' END AS reason FROM f"""
)
def reject_bitmask(t: Tables) -> DataFrame:
    return _flagged(t).select("event_type", F.col("d").cast("timestamp_ntz").alias("day"), "reject", windows.first_reason().alias("reason"))


@query(
    FLAGS_SQL + "SELECT event_type, CAST(count(*) AS BIGINT) AS n_windows, CAST(count(*) FILTER (WHERE reject = 0) AS BIGINT) AS n_good, "
    + ", ".join(f"round(avg(CASE WHEN reject & {int(r)} > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS frac_{r.name.lower()}" for r in Reject)
    + " FROM f GROUP BY event_type"
)
def qc_fractions(t: Tables) -> DataFrame:
    out = windows.quality_table(_flagged(t), ["event_type"])
    return out.select("event_type", "n_windows", "n_good", *[r6(c).alias(c) for c in out.columns if c.startswith("frac_")])


@query(
    "SELECT CAST(step * round_even(CAST(l_quantity AS DOUBLE) / step, 0) AS DOUBLE) AS grid, CAST(count(*) AS BIGINT) AS n, round(max(abs(l_quantity - step * round_even(l_quantity / step, 0))), 6) AS worst "
    "FROM (SELECT l_quantity, CAST(2 AS DOUBLE) AS step FROM lineitem) GROUP BY 1"
)
def requantize(t: Tables) -> DataFrame:
    grid = windows.requantize(F.col("l_quantity"), 2.0)
    return t.lineitem.groupBy(grid.alias("grid")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.max(F.abs(F.col("l_quantity") - grid))).alias("worst")
    )


@query(
    """
WITH w AS (SELECT user_id, date_trunc('day', ts) AS d, count(*) AS n, avg(value) AS v FROM events GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d) AS r FROM w)
SELECT user_id, CAST(count(*) AS BIGINT) AS n_windows, CAST(sum(n) AS BIGINT) AS n_events, round(avg(v), 6) AS mean_value FROM k WHERE r <= 9 GROUP BY user_id
"""
)
def first_segment(t: Tables) -> DataFrame:
    w = t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))
    # a row_number limit is cut to nine rows per key before the shuffle
    first = w.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("d"))).filter("r <= 9")
    return first.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n").alias("n_events"), r6(F.avg("v")).alias("mean_value"))


@query(
    """
WITH w AS (SELECT user_id, event_type, avg(value) AS v, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2)
SELECT user_id, """
    + ", ".join(
        f"round(max(CASE WHEN event_type = '{e}' THEN v END), 6) AS good_{e}, CAST(coalesce(max(CASE WHEN event_type = '{e}' THEN CASE WHEN top > 200 THEN 1 ELSE 0 END END), 0) AS INTEGER) AS copy_{e}"
        for e in ("click", "view", "purchase")
    )
    + " FROM w GROUP BY user_id"
)
def quality_pivot(t: Tables) -> DataFrame:
    kinds = ("click", "view", "purchase")
    is_ = lambda e: F.col("event_type") == e
    out = t.events.groupBy("user_id").agg(
        *[F.avg(F.when(is_(e), F.col("value"))).alias(f"g_{e}") for e in kinds],
        *[F.max(F.when(is_(e), F.col("value"))).alias(f"t_{e}") for e in kinds],
    )
    return out.select(
        "user_id",
        *[r6(f"g_{e}").alias(f"good_{e}") for e in kinds],
        *[F.coalesce((F.col(f"t_{e}") > 200).cast("int"), F.lit(0)).alias(f"copy_{e}") for e in kinds],
    )
