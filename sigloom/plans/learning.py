"""Model fitting, calibration, selection and scoring queries on labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators import learn, nested
from sigloom.plans.registry import Tables, query, r6

FEATURES = ("log_chars", "log_words", "log_lines", "upper_share")

FEAT_SQL = """
WITH RECURSIVE f AS (SELECT d.doc_id, d.source, l.quality AS y, CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE round(ln(CAST(d.n_chars AS DOUBLE) + 1), 9) END AS log_chars,
  round(ln(CAST(len(string_split(d.text, ' ')) AS DOUBLE)), 9) AS log_words
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""


# the same features of all documents
ALL_SQL = FEAT_SQL.replace("JOIN labels", "LEFT JOIN labels")


def described(t: Tables) -> DataFrame:
    """Document features; some values are missing on purpose."""
    text = F.col("text")
    size = F.col("n_chars").cast("double")
    return t.documents.select(
        "doc_id", "source", "lang",
        F.when(F.col("doc_id") % 7 != 0, F.round(F.ln(size + 1), 9)).alias("log_chars"),
        F.round(F.ln(F.size(F.split(text, " ")).cast("double")), 9).alias("log_words"),
        F.ln(F.size(F.split(text, "\n")).cast("double")).alias("log_lines"),
        (F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / (size + 1)).alias("upper_share"),
    )


def labelled(t: Tables) -> DataFrame:
    return described(t).join(t.labels, "doc_id").withColumn("y", F.col("quality"))


@query(
    FEAT_SQL + """, m AS (SELECT quantile_cont(log_chars, 0.5) AS med FROM f), z AS (SELECT f.doc_id, coalesce(log_chars, med) AS v, log_words AS u FROM f, m),
s AS (SELECT avg(v) AS mv, stddev_pop(v) AS sv, avg(u) AS mu, stddev_pop(u) AS su FROM z)
SELECT doc_id, round((v - mv) / sv, 6) + 0.0 AS z_chars, round((u - mu) / su, 6) + 0.0 AS z_words FROM z, s
"""
)
def impute_scale(t: Tables) -> DataFrame:
    rows = labelled(t)
    stats = learn.feature_table(rows, ["log_chars", "log_words"])
    model = learn.LogisticModel(("log_chars", "log_words"), *(tuple(stats[n][i] for n in ("log_chars", "log_words")) for i in range(3)), (0.0, 0.0), 0.0)
    z = model.standardized()
    return rows.select("doc_id", r6(z[0]).alias("z_chars"), r6(z[1]).alias("z_words"))


FIXED = learn.LogisticModel(
    ("log_chars", "log_words"), (6.0, 4.0), (6.5, 4.5), (1.5, 1.25), (0.8, -0.3), 0.25, calibration=(0.7, 0.2)
)


@query(
    ALL_SQL + """, z AS (SELECT doc_id, 0.8 * (coalesce(log_chars, 6) - 6.5) / 1.5 AS c1, -0.3 * (log_words - 4.5) / 1.25 AS c2 FROM f)
SELECT doc_id, round(c1, 6) + 0.0 AS part_chars, round(c2, 6) + 0.0 AS part_words, round(1 / (1 + exp(-(c1 + c2 + 0.25))), 6) AS p_raw,
       round(1 / (1 + exp(-(0.7 * (c1 + c2 + 0.25) + 0.2))), 6) AS p FROM z
"""
)
def linear_score(t: Tables) -> DataFrame:
    c1, c2 = FIXED.contributions()
    return described(t).select(
        "doc_id", r6(c1).alias("part_chars"), r6(c2).alias("part_words"), r6(FIXED.probability_raw()).alias("p_raw"), r6(FIXED.safe_probability()).alias("p")
    )


@query(
    FEAT_SQL + """, z AS (SELECT y, 0.8 * (coalesce(log_chars, 6) - 6.5) / 1.5 AS c1, -0.3 * (log_words - 4.5) / 1.25 AS c2 FROM f),
h AS (SELECT y, c1, c2, c1 + c2 + 0.25 >= 0 AS hit FROM z), l AS (SELECT hit, y, 'log_chars' AS feature, c1 AS v FROM h UNION ALL SELECT hit, y, 'log_words', c2 FROM h)
SELECT feature, round(avg(v) FILTER (WHERE hit AND y = 0) - avg(v) FILTER (WHERE NOT hit AND y = 0), 6) + 0.0 AS difference FROM l GROUP BY feature ORDER BY abs(difference) DESC LIMIT 8
"""
)
def contribution_gap(t: Tables) -> DataFrame:
    """Mean contribution of the model's features, false positives minus correct negatives, largest first."""
    parts = dict(zip(FIXED.feature_names, FIXED.contributions(), strict=True))
    rows = labelled(t).select((FIXED.probability_raw() >= 0.5).alias("hit"), "y", *[c.alias(n) for n, c in parts.items()])
    mean = lambda n, hit: F.avg(F.when((F.col("y") == 0) & (F.col("hit") == hit), F.col(n)))
    wide = rows.agg(F.lit(1).alias("one"), *[(mean(n, True) - mean(n, False)).alias(n) for n in parts])
    long = wide.unpivot("one", list(parts), "feature", "d")
    return long.orderBy(F.desc(F.abs("d"))).limit(8).select("feature", r6("d").alias("difference"))


def _newton_sql(ridge: str, c: str, weight: str) -> str:
    """Newton steps for two parameters as a recursive table."""
    return f"""
it(k, a, b) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL
  SELECT k + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT it.k, it.a, it.b, {ridge} * it.a + {c} * sum(w * (p - y) * x) AS ga, {c} * sum(w * (p - y)) AS gb,
        {ridge} + {c} * sum(w * p * (1 - p) * x * x) AS haa, {c} * sum(w * p * (1 - p) * x) AS hab, {c} * sum(w * p * (1 - p)) AS hbb
        FROM (SELECT it.k, it.a, it.b, x, y, {weight} AS w, 1 / (1 + exp(-(it.a * x + it.b))) AS p FROM it CROSS JOIN rows) it GROUP BY it.k, it.a, it.b) WHERE k < 25)
"""


@query(
    FEAT_SQL + """, q AS (SELECT y, least(greatest(1 / (1 + exp(-(0.8 * (coalesce(log_chars, 6) - 6.5) / 1.5 - 0.3 * (log_words - 4.5) / 1.25 + 0.25))), 1e-6), 1 - 1e-6) AS p0 FROM f),
rows AS (SELECT y, ln(p0 / (1 - p0)) AS x FROM q), """ + _newton_sql("1", "1e6", "1") + "SELECT round(a, 5) AS a, round(b, 5) AS b FROM it WHERE k = 25"
)
def platt_fit(t: Tables) -> DataFrame:
    a, b = learn.fit_platt(labelled(t), FIXED.probability_raw(), "y")
    return t.spark.createDataFrame([(a, b)], "a double, b double").select(F.round("a", 5).alias("a"), F.round("b", 5).alias("b"))


@query(
    FEAT_SQL + """, s AS (SELECT avg(log_words) AS m, stddev_pop(log_words) AS sd, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS np FROM f),
rows AS (SELECT y, (log_words - m) / sd AS x, CASE WHEN y = 1 THEN n / (2 * np) ELSE n / (2 * (n - np)) END AS sw FROM f, s), """
    + _newton_sql("1", "0.1", "sw") + "SELECT round(a, 6) AS coef, round(b, 6) AS intercept FROM it WHERE k = 25"
)
def logistic_fit(t: Tables) -> DataFrame:
    m = learn.fit_logistic(labelled(t), ["log_words"], "y", c=0.1)
    return t.spark.createDataFrame([(m.coef[0], m.intercept)], "coef double, intercept double").select(r6("coef").alias("coef"), r6("intercept").alias("intercept"))


@query()
def logistic_multi(t: Tables) -> DataFrame:
    """Four-feature balanced fit; one row per coefficient."""
    m = learn.fit_logistic(labelled(t), FEATURES, "y", c=0.3)
    rows = [(n, float(w)) for n, w in zip((*m.feature_names, "(intercept)"), (*m.coef, m.intercept))]
    return t.spark.createDataFrame(rows, "term string, weight double").select("term", r6("weight").alias("weight"))


def population(t: Tables) -> DataFrame:
    """Rows of the nested evaluation: sources play the independence groups, languages the control strata."""
    rows = labelled(t)
    stratum = F.when(F.col("y") == 1, "ptsd").when(F.col("toxic") == 1, "somatoform").otherwise(F.concat(F.lit("control_"), F.col("lang")))
    group = F.regexp_extract("source", r"(\d+)", 1).cast("long")
    return rows.select(F.col("doc_id").alias("row"), group.alias("grp"), "y", stratum.alias("stratum"), *FEATURES)


PROTOCOL = nested.Protocol(
    name="documents",
    feature_sets={"size": FEATURES[:3], "all": FEATURES},
    candidates=tuple(nested.Candidate(c, n, f, w) for w in (1.0, 3.0) for f in ("size", "all") for n in nested.NEGATIVES for c in nested.C_GRID),
    controls=("control_en", "control_de", "control_fr", "control_es"),
)


@query()
def nested_select(t: Tables) -> DataFrame:
    """Leave-one-group-out probabilities of the whole procedure: selection, fit and calibration."""
    out = nested.nested_oof(population(t), PROTOCOL)
    return out.select("row", "grp", "candidate", r6("p_raw").alias("p_raw"), r6("p").alias("p"))


@query()
def candidate_frequency(t: Tables) -> DataFrame:
    """How often each candidate was chosen, counted once per outer fold."""
    return nested.candidate_frequency(nested.nested_oof(population(t), PROTOCOL))
