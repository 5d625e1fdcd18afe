"""Projections, joins, set operations, pivots and grouped summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions import circular, text
from sigloom.functions.numeric import day_seconds
from sigloom.operators import folds, ordered
from sigloom.plans.registry import Tables, query, r6

KINDS = ("click", "error", "purchase", "signup", "view")


@query(
    """
WITH u AS (SELECT DISTINCT c_custkey FROM customer),
p AS (SELECT * FROM (VALUES ('1-URGENT', 0), ('2-HIGH', 1), ('3-MEDIUM', 2), ('4-NOT SPECIFIED', 3), ('5-LOW', 4)) v(stem, trial)),
o AS (SELECT o_custkey, o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
SELECT u.c_custkey, p.stem, CAST(p.trial AS INTEGER) AS trial, CASE WHEN o.n IS NULL THEN 'missing' ELSE 'ok' END AS status, CAST(coalesce(o.n, 0) AS BIGINT) AS n, round(o.total, 2) AS total
FROM u CROSS JOIN p LEFT JOIN o ON o.o_custkey = u.c_custkey AND o.o_orderpriority = p.stem
"""
)
def registry_expected_left_join(t: Tables) -> DataFrame:
    """One row per expected (subject, slot), present or not."""
    slots = [(s, i) for i, s in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))]
    fixed = F.explode(F.array(*[F.struct(F.lit(s).alias("stem"), F.lit(i).alias("trial")) for s, i in slots])).alias("slot")
    expected = t.customer.select("c_custkey", fixed).select("c_custkey", "slot.stem", "slot.trial")
    found = t.orders.groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("stem")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")
    )
    out = expected.join(found, ["c_custkey", "stem"], "left")
    return out.select(
        "c_custkey", "stem", "trial", F.when(F.col("n").isNull(), "missing").otherwise("ok").alias("status"),
        F.coalesce("n", F.lit(0)).alias("n"), F.round("total", 2).alias("total"),
    )


@query(
    """SELECT translate(upper(trim('  ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN 'Т' ELSE 't' END || ' ')), 'АВЕКМНОРСТХ', 'ABEKMHOPCTX') AS stem,
       CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1"""
)
def stem_normalize(t: Tables) -> DataFrame:
    last = F.when(F.col("p_partkey") % 2 == 0, "Т").otherwise("t")
    raw = F.concat(F.lit("  "), "p_name", last, F.lit(" "))
    return t.part.groupBy(text.normalize_stem(raw).alias("stem")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """
WITH n AS (SELECT c_custkey, c_mktsegment, 'c_' || CAST(c_custkey % 130 AS VARCHAR) || CASE WHEN c_custkey % 3 = 0 THEN 'b' ELSE '' END AS code FROM customer),
a AS (SELECT c_custkey, code, CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(nullif(regexp_extract(code, '_(\\d{2})[^\\d_]*$', 1), '') AS DOUBLE) END AS age FROM n)
SELECT c_custkey, code, age, coalesce(age >= 65, false) AS holdout FROM a
"""
)
def regex_age(t: Tables) -> DataFrame:
    code = F.concat(
        F.lit("c_"), (F.col("c_custkey") % 130).cast("string"), F.when(F.col("c_custkey") % 3 == 0, "b").otherwise("")
    )
    age = text.age_from_name(code, F.col("c_mktsegment") != "BUILDING")
    return t.customer.select("c_custkey", code.alias("code"), age.alias("age"), text.at_least(age, 65.0).alias("holdout"))


@query(
    """
WITH f AS (SELECT o_custkey, CASE WHEN o_totalprice < 50000 THEN '' WHEN o_orderstatus = 'F' THEN 'A' WHEN o_orderpriority = '5-LOW' THEN 'B' ELSE 'C' END AS family FROM orders)
SELECT c.c_mktsegment AS segment, f.family, CASE WHEN c.c_mktsegment = 'BUILDING' THEN 'ptsd' WHEN c.c_acctbal < 0 THEN 'control_ageing' WHEN c.c_mktsegment = 'MACHINERY' THEN 'somatoform'
  WHEN c.c_nationkey < 5 THEN CASE WHEN f.family = 'B' THEN 'control_B_supplement' ELSE 'control_' || f.family || '_supplement' END ELSE 'control_' || f.family END AS stratum, CAST(count(*) AS BIGINT) AS n
FROM f JOIN customer c ON f.o_custkey = c.c_custkey GROUP BY 1, 2, 3
"""
)
def family_case(t: Tables) -> DataFrame:
    from sigloom.functions.strata import stratum

    step = F.when(F.col("o_totalprice") < 50000, None).when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.061)
    top = F.when(F.col("o_orderpriority") == "5-LOW", 2000.0).otherwise(1000.0)
    fam = t.orders.select(F.col("o_custkey").alias("c_custkey"), text.export_family(step, top).alias("family"))
    seg = F.col("c_mktsegment")
    joined = fam.join(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey"), "c_custkey")
    s = stratum(seg == "BUILDING", F.col("c_acctbal") < 0, seg == "MACHINERY", F.col("c_nationkey") >= 5, F.col("family"))
    return joined.groupBy(seg.alias("segment"), "family", s.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """
SELECT n_name, c_custkey, c_acctbal, CAST(r AS INTEGER) AS r FROM (SELECT c_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer)
JOIN nation ON n_nationkey = c_nationkey WHERE r <= 3
"""
)
def limit_per_group(t: Tables) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    first = t.customer.select("c_nationkey", "c_custkey", "c_acctbal", r.alias("r")).filter("r <= 3")
    return first.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_custkey", "c_acctbal", "r")


@query(
    """
WITH p AS (SELECT l_orderkey, l_linenumber, round(log10(sum(l_extendedprice)), 9) AS lg FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, round(avg(lg), 6) AS mean_log, round(regr_slope(lg, l_linenumber), 6) + 0.0 AS slope,
       round(max(CASE WHEN l_linenumber = 1 THEN lg END) - avg(CASE WHEN l_linenumber > 1 THEN lg END), 6) + 0.0 AS first_excess
FROM p GROUP BY l_orderkey HAVING count(*) >= 2 AND count(*) = max(l_linenumber)
"""
)
def task_slope(t: Tables) -> DataFrame:
    """Mean, trend and first-step excess of a log series, only for series without a missing step."""
    step = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.round(F.log10(F.sum("l_extendedprice")), 9).alias("lg"))
    first = F.col("l_linenumber") == 1
    return (
        step.groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("l_linenumber").alias("last"),
            r6(F.avg("lg")).alias("mean_log"),
            r6(F.regr_slope("lg", "l_linenumber")).alias("slope"),
            r6(F.max(F.when(first, F.col("lg"))) - F.avg(F.when(~first, F.col("lg")))).alias("first_excess"),
        )
        .filter("n >= 2 AND n = last")
        .drop("n", "last")
    )


@query(
    """
SELECT l_orderkey, CASE WHEN same THEN NULL ELSE first END AS first_quantity, CASE WHEN NOT same AND n >= 3 THEN total END AS total_quantity, same AS templated, CAST(CASE WHEN same THEN 0 ELSE n END AS BIGINT) AS n_trials
FROM (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS total, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS first, count(*) >= 2 AND max(l_quantity) = min(l_quantity) AS same FROM lineitem GROUP BY l_orderkey)
"""
)
def templated_times(t: Tables) -> DataFrame:
    """Series in which every value is equal are templates, not measurements: their times become NULL."""
    q, n = F.col("l_quantity"), F.count(F.lit(1))
    out = t.lineitem.groupBy("l_orderkey").agg(
        n.alias("n"), F.sum(q).alias("total"), F.max(F.when(F.col("l_linenumber") == 1, q)).alias("first"),
        ((n >= 2) & (F.max(q) == F.min(q))).alias("templated"),
    )
    fresh = ~F.col("templated")
    return out.select(
        "l_orderkey", F.when(fresh, F.col("first")).alias("first_quantity"),
        F.when(fresh & (F.col("n") >= 3), F.col("total")).alias("total_quantity"), "templated",
        F.when(fresh, F.col("n")).otherwise(F.lit(0)).alias("n_trials"),
    )


@query(
    "SELECT o_orderpriority, " + ", ".join(f"round(avg(CASE WHEN o_orderstatus = '{s}' THEN o_totalprice END), 4) AS mean_{s}" for s in "FOP") + " FROM orders GROUP BY o_orderpriority"
)
def pivot_mean(t: Tables) -> DataFrame:
    out = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", list("FOP")).agg(F.avg("o_totalprice"))
    return out.select("o_orderpriority", *[F.round(F.col(s), 4).alias(f"mean_{s}") for s in "FOP"])


@query(
    "SELECT event_type, " + ", ".join(f"CAST(count(*) FILTER (WHERE user_id % 4 = {i}) AS BIGINT) AS n_{i}" for i in range(4)) + " FROM events GROUP BY event_type"
)
def crosstab(t: Tables) -> DataFrame:
    out = t.events.select("event_type", (F.col("user_id") % 4).alias("arm")).groupBy("event_type").pivot("arm", [0, 1, 2, 3]).count()
    return out.select("event_type", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"n_{i}") for i in range(4)])


@query(
    "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, min(l_extendedprice) AS lo, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50, "
    "round(quantile_cont(l_extendedprice, 0.75), 6) AS q75, max(l_extendedprice) AS hi, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd FROM lineitem GROUP BY l_returnflag"
)
def describe(t: Tables) -> DataFrame:
    v = "l_extendedprice"
    q = ordered.quantiles(t.lineitem.select("l_returnflag", v), ["l_returnflag"], v, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    s = t.lineitem.groupBy("l_returnflag").agg(
        F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("sd")
    )
    return s.join(q, "l_returnflag").select("l_returnflag", "n", "lo", r6("q25").alias("q25"), r6("q50").alias("q50"), r6("q75").alias("q75"), "hi", "mean", "sd")


@query("SELECT c_mktsegment AS value, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT c_nationkey) AS BIGINT) AS n_nations, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY c_mktsegment")
def value_counts(t: Tables) -> DataFrame:
    out = t.customer.groupBy(F.col("c_mktsegment").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c_nationkey").alias("n_nations"))
    total = t.customer.agg(F.count(F.lit(1)).alias("total"))
    return out.crossJoin(F.broadcast(total)).select("value", "n", "n_nations", r6(F.col("n") / F.col("total")).alias("share"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS statuses, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS n_priorities FROM orders GROUP BY o_custkey")
def joined_sets(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "").alias("statuses"),
        F.countDistinct("o_orderpriority").alias("n_priorities"),
    )


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(t: Tables) -> DataFrame:
    big = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_name").join(big, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(t: Tables) -> DataFrame:
    big = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_name").join(big, "c_custkey", "left_anti")


@query(
    "SELECT 'customer' AS kind, c_nationkey AS nation, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 2 "
    "UNION ALL SELECT 'supplier', s_nationkey, CAST(count(*) AS BIGINT), round(sum(s_acctbal), 2) FROM supplier GROUP BY 2"
)
def union_reports(t: Tables) -> DataFrame:
    def report(df: DataFrame, kind: str, key: str, money: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(money), 2).alias("balance")).withColumn("kind", F.lit(kind))

    return report(t.customer, "customer", "c_nationkey", "c_acctbal").unionByName(report(t.supplier, "supplier", "s_nationkey", "s_acctbal")).select("kind", "nation", "n", "balance")


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nation")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_keys(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.select("o_custkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
def top_k(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(12)


@query(
    """
WITH m AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS med FROM orders GROUP BY 1),
d AS (SELECT o.o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o.o_orderpriority ORDER BY round(abs(o_totalprice - med), 6), o_orderkey) AS r FROM orders o JOIN m ON o.o_orderpriority = m.o_orderpriority)
SELECT o_orderpriority, o_orderkey, o_totalprice FROM d WHERE r = 1
"""
)
def nearest_to_median(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice")
    mid = ordered.median(rows, ["o_orderpriority"], "o_totalprice", "med")
    gap = F.struct(F.round(F.abs(F.col("o_totalprice") - F.col("med")), 6), F.col("o_orderkey"))
    best = F.min_by(F.struct("o_orderkey", "o_totalprice"), gap)
    return rows.join(mid, "o_orderpriority").groupBy("o_orderpriority").agg(best.alias("b")).select("o_orderpriority", "b.o_orderkey", "b.o_totalprice")


@query(
    "SELECT n_name, CAST(dense_rank() OVER (ORDER BY n_name) - 1 AS BIGINT) AS code, CAST(n AS BIGINT) AS n FROM (SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name)"
)
def factorize(t: Tables) -> DataFrame:
    """Dense integer codes in key order, without ordering the whole table in one task."""
    keys = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    keys = keys.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n")
    code = folds.dense_index(keys, "n_name", name="code").select("n_name", "code")
    return keys.join(code, "n_name").select("n_name", "code", "n")


@query(
    """
WITH a AS (SELECT user_id, date_trunc('day', ts) AS d, sum(value) FILTER (WHERE event_type = 'click') AS x, sum(value) FILTER (WHERE event_type = 'view') AS y FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
l AS (SELECT user_id, ln(y) - ln(x) AS v FROM a WHERE x > 0 AND y > 0)
SELECT user_id, round(avg(v), 6) + 0.0 AS asymmetry, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY user_id HAVING count(*) >= 5
"""
)
def asymmetry(t: Tables) -> DataFrame:
    """Mean log ratio of two channels over the windows where both have power; needs five windows."""
    pick = lambda e: F.sum(F.when(F.col("event_type") == e, F.col("value")))
    daily = t.events.filter(F.col("event_type").isin("click", "view")).groupBy("user_id", F.to_date("ts").alias("d"))
    both = daily.agg(pick("click").alias("x"), pick("view").alias("y")).filter("x > 0 AND y > 0")
    out = both.groupBy("user_id").agg(F.avg(F.ln("y") - F.ln("x")).alias("v"), F.count(F.lit(1)).alias("n"))
    return out.filter("n >= 5").select("user_id", r6("v").alias("asymmetry"), "n")


@query(
    """
WITH h AS (SELECT date_trunc('hour', ts) AS h, """ + ", ".join(f"sum(value) FILTER (WHERE event_type = '{e}') AS {e}" for e in KINDS) + """ FROM events GROUP BY 1)
""" + " UNION ALL ".join(
        f"SELECT '{a}-{b}' AS pair, CAST(count(*) AS BIGINT) AS n, round(corr({a}, {b}), 6) AS r FROM h WHERE " + " AND ".join(f"{e} IS NOT NULL" for e in KINDS)
        for a, b in (("click", "view"), ("purchase", "signup"), ("error", "view"))
    )
)
def channel_corr(t: Tables) -> DataFrame:
    """Correlations of channel pairs over the windows that are complete on every channel."""
    hours = t.events.groupBy(F.to_date("ts").alias("d"), F.hour("ts").alias("h")).pivot("event_type", list(KINDS)).agg(F.sum("value")).dropna(subset=list(KINDS))
    pairs = (("click", "view"), ("purchase", "signup"), ("error", "view"))
    wide = hours.agg(F.count(F.lit(1)).alias("n"), *[F.corr(a, b).alias(f"{a}-{b}") for a, b in pairs])
    return wide.unpivot("n", [f"{a}-{b}" for a, b in pairs], "pair", "r").select("pair", "n", r6("r").alias("r"))


@query(
    """
WITH w AS (SELECT event_type, date_trunc('day', ts) AS d, var_pop(value) AS v FROM events GROUP BY 1, 2),
m AS (SELECT event_type, sqrt(quantile_cont(v, 0.5)) AS rms FROM w GROUP BY event_type)
SELECT a.event_type, round(max(a.rms) / quantile_cont(b.rms, 0.5), 6) AS ratio FROM m a JOIN m b ON a.event_type <> b.event_type GROUP BY a.event_type
"""
)
def rms_ratio(t: Tables) -> DataFrame:
    """RMS of one channel over the median RMS of the other channels."""
    w = t.events.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.var_pop("value").alias("v"))
    rms = ordered.median(w, ["event_type"], "v", "mid").select("event_type", F.sqrt("mid").alias("rms"))
    place = ordered.scan(ordered.range_bucket(rms, "rms"), [], ["rms"], {"_at": F.lit(1).cast("long")}, {"_n": "_at"}).select("event_type", "rms", (F.col("_at") - 1).alias("at"), "_n")
    # without the row itself, the middle of the others is at these places of the whole order
    skip = lambda k: F.when(k < F.col("at"), k).otherwise(k + 1).cast("long")
    rows = place.filter("_n > 1").withColumns({"lo": skip(F.floor((F.col("_n") - 2) / 2)), "hi": skip(F.floor((F.col("_n") - 1) / 2))})
    named = lambda at, value: place.select(F.col("at").alias(at), F.col("rms").alias(value))
    both = rows.join(named("lo", "below"), "lo").join(named("hi", "above"), "hi")
    return both.select("event_type", r6(F.col("rms") / ((F.col("below") + F.col("above")) / 2)).alias("ratio"))


@query(
    """
WITH p AS (SELECT event_type, user_id, (epoch(ts) - epoch(date_trunc('day', ts))) / 3600 AS h FROM events),
m AS (SELECT event_type, atan2(avg(sin(h * 2 * pi() / 24)), avg(cos(h * 2 * pi() / 24))) * 24 / (2 * pi()) AS mu FROM p GROUP BY event_type)
SELECT p.event_type, round(max(mu), 6) AS mean_hour, round(avg(abs((h - mu + 12) - 24 * floor((h - mu + 12) / 24) - 12)), 6) AS mean_error,
       round(avg(CASE WHEN abs((h - mu + 12) - 24 * floor((h - mu + 12) / 24) - 12) <= 3 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS within_3h
FROM p JOIN m ON p.event_type = m.event_type GROUP BY p.event_type
"""
)
def circular_stats(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", (day_seconds(F.col("ts")) / 3600).alias("h"))
    mean = rows.groupBy("event_type").agg(circular.circular_mean(F.col("h"), 24.0).alias("mu"))
    err = F.abs(circular.circular_error(F.col("h"), F.col("mu"), 24.0))
    return rows.join(mean, "event_type").groupBy("event_type").agg(
        r6(F.max("mu")).alias("mean_hour"), r6(F.avg(err)).alias("mean_error"), r6(F.avg((err <= 3).cast("double"))).alias("within_3h")
    )


@query(
    """
WITH w AS (SELECT d.source, d.lang, l.quality, l.toxic, CASE WHEN d.n_chars >= 100 THEN d.n_chars END AS size FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT lang, feature, round(avg(CASE WHEN v IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS missing FROM
 (SELECT lang, 'quality' AS feature, CAST(quality AS BIGINT) AS v FROM w UNION ALL SELECT lang, 'toxic', toxic FROM w UNION ALL SELECT lang, 'size', size FROM w) GROUP BY lang, feature
"""
)
def missing_share(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", F.when(F.col("n_chars") >= 100, F.col("n_chars")).alias("size")).join(t.labels, "doc_id", "left")
    cols = ("quality", "toxic", "size")
    wide = rows.groupBy("lang").agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return wide.unpivot("lang", list(cols), "feature", "missing").select("lang", "feature", r6("missing").alias("missing"))


@query(
    """
WITH g AS (SELECT c_nationkey, c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY ALL HAVING count(*) > 1)
SELECT c.c_nationkey, c.c_mktsegment, c.c_custkey AS member, g.n FROM customer c JOIN g ON c.c_nationkey = g.c_nationkey AND c.c_mktsegment = g.c_mktsegment
"""
)
def shared_groups(t: Tables) -> DataFrame:
    """All members of groups with more than one: a row a member, so no group has to fit one row."""
    keys = ["c_nationkey", "c_mktsegment"]
    sizes = t.customer.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return t.customer.join(sizes, keys).select(*keys, F.col("c_custkey").alias("member"), "n")


@query(
    """
SELECT event_type, CASE WHEN value <= 10 THEN '<=10' WHEN value <= 40 THEN '10-40' WHEN value <= 100 THEN '40-100' ELSE '>100' END AS band_right,
       CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE value = 10 OR value = 40 OR value = 100) AS BIGINT) AS on_edge FROM events GROUP BY 1, 2
"""
)
def binning(t: Tables) -> DataFrame:
    """Right-closed bins."""
    v = F.col("value")
    band = F.when(v <= 10, "<=10").when(v <= 40, "10-40").when(v <= 100, "40-100").otherwise(">100")
    return t.events.groupBy("event_type", band.alias("band_right")).agg(F.count(F.lit(1)).alias("n"), F.count_if(v.isin(10.0, 40.0, 100.0)).alias("on_edge"))


@query(
    """
WITH k(x, y) AS (VALUES (CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)), (10, 5), (40, 9), (100, 20), (400, 21)),
s AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM k)
SELECT e.event_id, round(coalesce(s.y + (e.value - s.x) * (s.y1 - s.y) / (s.x1 - s.x), 21), 6) AS level FROM events e LEFT JOIN s ON e.value >= s.x AND e.value < s.x1
"""
)
def interpolate(t: Tables) -> DataFrame:
    """Piecewise-linear lookup in a fixed table of knots, clamped at both ends."""
    from sigloom.functions.numeric import interp

    level = interp(F.col("value"), (0.0, 10.0, 40.0, 100.0, 400.0), (0.0, 5.0, 9.0, 20.0, 21.0))
    return t.events.select("event_id", r6(level).alias("level"))


@query(
    """
WITH r AS (SELECT l_returnflag AS variant, CAST(l_linenumber AS BIGINT) AS amplitude, l_orderkey AS replicate, avg(l_quantity) AS stat, avg(l_discount) AS energy FROM lineitem GROUP BY 1, 2, 3),
n AS (SELECT o_orderstatus AS variant, CAST(extract('day' FROM o_orderdate) % 7 + 1 AS BIGINT) AS amplitude, quantile_cont(o_totalprice, 0.95) / 10000 AS q FROM orders GROUP BY 1, 2),
m AS (SELECT r.variant, r.amplitude, round(r.stat, 9) > round(n.q - 15, 9) AS d2, round(r.energy, 9) > 0.05 AS d3, r.stat FROM r JOIN n ON r.amplitude = n.amplitude AND n.variant = CASE r.variant WHEN 'A' THEN 'F' WHEN 'N' THEN 'O' ELSE 'P' END)
SELECT variant, amplitude, round(amplitude * 1.5, 6) AS difference_rms, round(avg(CASE WHEN d2 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS test2_power, round(avg(CASE WHEN d3 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS test3_power, round(avg(stat), 6) AS stat FROM m GROUP BY 1, 2
"""
)
def power_summary(t: Tables) -> DataFrame:
    """Two-key join of replicates with their null thresholds, then detection shares per cell."""
    reps = t.lineitem.groupBy(F.col("l_returnflag").alias("variant"), F.col("l_linenumber").cast("long").alias("amplitude"), "l_orderkey").agg(
        F.avg("l_quantity").alias("stat"), F.avg("l_discount").alias("energy")
    )
    cell = t.orders.select(
        F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "N").otherwise("R").alias("variant"),
        (F.dayofmonth("o_orderdate") % 7 + 1).cast("long").alias("amplitude"), "o_totalprice",
    )
    nulls = ordered.quantiles(cell, ["variant", "amplitude"], "o_totalprice", {"q": 0.95})
    m = reps.join(nulls, ["variant", "amplitude"])
    d2 = F.round(F.col("stat"), 9) > F.round(F.col("q") / 10000 - 15, 9)
    return m.groupBy("variant", "amplitude").agg(
        r6(F.avg(d2.cast("double"))).alias("test2_power"), r6(F.avg((F.round("energy", 9) > 0.05).cast("double"))).alias("test3_power"), r6(F.avg("stat")).alias("stat")
    ).withColumn("difference_rms", r6(F.col("amplitude") * F.lit(1.5)))


@query(
    """
WITH b AS (SELECT r_name, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 5000 THEN 'middle' ELSE 'high' END AS band FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT band, """ + ", ".join(f"CAST(count(*) FILTER (WHERE r_name = '{r}') AS BIGINT) AS \"{r}\"" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM b GROUP BY band"
)
def bands_by_stratum(t: Tables) -> DataFrame:
    bal = F.col("c_acctbal")
    band = F.when(bal < 0, "negative").when(bal < 5000, "middle").otherwise("high")
    regions = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    # shrink to (nation, band) counts before joining the names
    small = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey"), band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    named = small.join(t.nation, "n_nationkey").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    out = named.groupBy("band").pivot("r_name", regions).agg(F.sum("n"))
    return out.select("band", *[F.coalesce(F.col(f"`{r}`"), F.lit(0)).alias(r) for r in regions])


@query(
    """
WITH o AS (SELECT o_custkey AS k, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders GROUP BY 1), f AS (SELECT o_custkey AS k, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, CAST(coalesce(o.n, 0) AS BIGINT) AS all_n, o.top AS all_top, CAST(coalesce(f.n, 0) AS BIGINT) AS filled_n, f.top AS filled_top FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN f ON f.k = c_custkey
"""
)
def column_concat(t: Tables) -> DataFrame:
    """Two reports side by side under prefixed names, aligned to all customers in one pass over the orders."""
    filled = F.col("o_orderstatus") == "F"
    both = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("all_n"), F.round(F.max("o_totalprice"), 2).alias("all_top"),
        F.count_if(filled).alias("filled_n"), F.round(F.max(F.when(filled, F.col("o_totalprice"))), 2).alias("filled_top"),
    )
    out = t.customer.select("c_custkey").join(both, "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("all_n", F.lit(0)).alias("all_n"), "all_top", F.coalesce("filled_n", F.lit(0)).alias("filled_n"), "filled_top")
