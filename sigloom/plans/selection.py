"""Selection and permutation queries on labelled documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators import evaluation, nested, permutations, task_branch
from sigloom.plans.learning import FEAT_SQL, FIXED, PROTOCOL, population
from sigloom.plans.registry import Tables, query, r6
from sigloom.plans.resampling import _permuted, h32
from sigloom.plans.statistics import SCORED, scored

N_PERMUTATIONS = 100


@query(
    SCORED + "," + _permuted(20) + f""", n AS (SELECT source, count(*) AS n FROM scored GROUP BY source),
s AS (SELECT perm, m.source, md5(concat_ws(':', stratum, n)) AS shape FROM moved m JOIN n ON n.source = m.source)
SELECT CAST(s.perm AS INTEGER) AS perm, s.source AS grp, m.stratum, CAST((row_number() OVER (PARTITION BY s.perm ORDER BY shape, {h32("'42'", "s.source")}, s.source) - 1) % 5 AS INTEGER) AS fold
FROM s JOIN moved m ON m.perm = s.perm AND m.source = s.source"""
)
def permuted_folds(t: Tables) -> DataFrame:
    """Moved strata of 20 permutations and the inner folds dealt anew for each."""
    rows = scored(t).select(F.col("doc_id").alias("row"), F.col("source").alias("grp"), "y", "stratum")
    return permutations.permuted_strata(rows, 20).select("perm", "grp", F.col("_stratum").alias("stratum"), "fold")


@query()
def permutation_procedure(t: Tables) -> DataFrame:
    """Null distribution of the nested area: 100 permutations of selection, fit and calibration in one job."""
    protocol = replace(PROTOCOL, candidates=tuple(c for c in PROTOCOL.candidates if c.features == "size" and c.spec_weight == 1))
    null = permutations.null_distribution(population(t), protocol, N_PERMUTATIONS, F.col("stratum").startswith("control_"), "p_raw")
    return null.select("permutation", r6("auc").alias("auc"))


# five scores of every scored document play the candidates
CANDIDATES_SQL = SCORED + """, c AS (SELECT CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS "outer", k AS candidate, stratum = 'ptsd' AS hit,
  round(p + ((n_chars * (7 * k + 3)) % 101) / (200.0 * (k + 1)), 9) AS s FROM scored CROSS JOIN range(0, 5) r(k)),
a AS (SELECT "outer", candidate, coalesce((sum(ar) FILTER (WHERE hit) - max(np) * (max(np) + 1) / CAST(2 AS DOUBLE)) / nullif(max(np) * max(nn), 0), 0) AS auc FROM (
  SELECT *, rank() OVER (PARTITION BY "outer", candidate ORDER BY s) + (count(*) OVER (PARTITION BY "outer", candidate, s) - 1) / CAST(2 AS DOUBLE) AS ar,
    CAST(count(*) FILTER (WHERE hit) OVER (PARTITION BY "outer", candidate) AS DOUBLE) AS np, CAST(count(*) FILTER (WHERE NOT hit) OVER (PARTITION BY "outer", candidate) AS DOUBLE) AS nn FROM c) GROUP BY ALL)"""


@query(CANDIDATES_SQL + """ SELECT "outer", CAST(candidate AS INTEGER) AS candidate, round(auc, 6) + 0.0 AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY "outer" ORDER BY round(auc, 9) DESC, candidate) AS r FROM a) WHERE r = 1""")
def ordered_selection(t: Tables) -> DataFrame:
    """Selection of C alone: per left-out group the first candidate that beats all before it."""
    protocol = task_branch.procedure("documents", ("s",))
    score = lambda k: F.round(F.col("p") + ((F.col("n_chars") * (7 * k + 3)) % 101) / F.lit(200.0 * (k + 1)), 9)
    options = F.explode(F.array(*[F.struct(F.lit(k).alias("candidate"), score(k).alias("p")) for k in range(5)])).alias("c")
    rows = scored(t).select(F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("outer"), "stratum", options).select("outer", "stratum", "c.*")
    chosen = nested.choose(nested.criterion(rows, ["outer", "candidate"], protocol), protocol)
    return chosen.select("outer", "candidate", r6("score").alias("score"))


def _area_sql(negative: str) -> str:
    return f"""(SELECT sum(CASE WHEN a.v > b.v THEN CAST(1 AS DOUBLE) WHEN a.v = b.v THEN 0.5 ELSE 0 END) / count(*) FROM z a JOIN z b ON a.model = b.model AND a.stratum = 'ptsd' AND {negative} WHERE a.model = m.model)"""


@query(
    SCORED + f""", f AS (SELECT s.doc_id, s.stratum, CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE round(ln(CAST(d.n_chars AS DOUBLE) + 1), 9) END AS log_chars,
  round(ln(CAST(len(string_split(d.text, ' ')) AS DOUBLE)), 9) AS log_words FROM scored s JOIN documents d ON d.doc_id = s.doc_id),
b AS (SELECT *, 0.8 * (coalesce(log_chars, 6) - 6.5) / 1.5 AS c1, -0.3 * (log_words - 4.5) / 1.25 AS c2 FROM f),
z AS (SELECT 'rest' AS model, stratum, round(c1, 9) AS v FROM b UNION ALL SELECT 'behaviour', stratum, round(c2, 9) FROM b UNION ALL SELECT 'combined', stratum, round(c1 + c2, 9) FROM b)
SELECT model, round(30 * greatest(0, ({_area_sql("b.stratum IN ('control_A', 'control_B')")} - 0.5) / 0.5) + 20 * greatest(0, ({_area_sql("b.stratum IN ('control_ageing', 'somatoform')")} - 0.5) / 0.5), 6) + 0.0 AS score,
  round({_area_sql("b.stratum <> 'ptsd'")}, 6) AS auc_all FROM (SELECT DISTINCT model FROM z) m"""
)
def branch_scores(t: Tables) -> DataFrame:
    """Criterion of the two-branch model for either branch and both, and the area against all others."""
    from sigloom.operators import ordered
    from sigloom.plans.learning import described

    chars, words = FIXED.contributions()
    rows = scored(t).select("doc_id", "stratum").join(described(t).select("doc_id", chars.alias("c1"), words.alias("c2")), "doc_id")
    branches = {"rest": F.col("c1"), "behaviour": F.col("c2"), "combined": F.col("c1") + F.col("c2")}
    long = rows.select("stratum", F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.round(v, 9).alias("p")) for n, v in branches.items()])).alias("b")).select("stratum", "b.*")
    scores = nested.criterion(long, ["model"], task_branch.procedure("two branches", ("s",), True))
    every = ordered.auc(long, ["model"], "p", F.col("stratum") == "ptsd", name="auc_all")
    return scores.join(every, "model").select("model", r6("score").alias("score"), r6("auc_all").alias("auc_all"))


GROUPED_SQL = FEAT_SQL + ", g AS (SELECT doc_id AS r, CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS grp, y, log_words AS x, log_chars AS t FROM f), o AS (SELECT DISTINCT grp AS o FROM g)"


@query(
    GROUPED_SQL + """, w AS (SELECT o, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS np FROM o JOIN g ON g.grp <> o GROUP BY o),
it(o, k, a, b) AS (SELECT o, 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM o UNION ALL
  SELECT o, k + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT o, k, a, b, a + sum(w * (p - y) * x) AS ga, sum(w * (p - y)) AS gb, 1 + sum(w * p * (1 - p) * x * x) AS haa, sum(w * p * (1 - p) * x) AS hab, sum(w * p * (1 - p)) AS hbb
        FROM (SELECT it.o, it.k, it.a, it.b, x, y, CASE WHEN y = 1 THEN n / (2 * np) ELSE n / (2 * (n - np)) END AS w, 1 / (1 + exp(-(it.a * x + it.b))) AS p FROM it JOIN w ON w.o = it.o JOIN g ON g.grp <> it.o) GROUP BY o, k, a, b) WHERE k < 25)
SELECT r AS row, round(1 / (1 + exp(-(a * x + b))), 6) AS p FROM g JOIN it ON it.o = g.grp WHERE k = 25"""
)
def metadata_oof(t: Tables) -> DataFrame:
    """Leave-one-group-out probabilities of a fixed model of one plain descriptor."""
    out = evaluation.fixed_oof(population(t), ["log_words"], scale=False)
    return out.select("row", r6("p").alias("p"))


# one feature: standardised per training set, alpha by leave-one-out error
RIDGE_SQL = GROUPED_SQL + f""", k AS (SELECT * FROM g WHERE t IS NOT NULL), m AS (SELECT o, CAST(count(*) AS DOUBLE) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(t) AS mt, covar_pop(x, t) / stddev_pop(x) * count(*) AS zt FROM o JOIN k ON k.grp <> o GROUP BY o),
al AS (SELECT m.*, alpha, zt / (n + alpha) AS coef FROM m CROSS JOIN (SELECT unnest([{', '.join(f'CAST({a} AS DOUBLE)' for a in evaluation.AGE_RIDGE_ALPHAS)}]) AS alpha)),
loo AS (SELECT o, alpha, sum(pow((t - mt - (x - mx) / sx * coef) / (1 - 1 / n - pow((x - mx) / sx, 2) / (n + alpha)), 2)) AS sse FROM al JOIN k ON k.grp <> o GROUP BY o, alpha),
best AS (SELECT o, alpha FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY sse, alpha) AS i FROM loo) WHERE i = 1),
p AS (SELECT r, t, mt + (x - mx) / sx * coef AS predicted, mt AS reference FROM k JOIN best ON best.o = k.grp JOIN al ON al.o = best.o AND al.alpha = best.alpha)"""


@query(RIDGE_SQL + " SELECT r AS row, round(t, 6) AS target, round(predicted, 5) AS predicted, round(reference, 5) AS reference FROM p")
def ridge_oof(t: Tables) -> DataFrame:
    """Leave-one-group-out ridge prediction of a number, alpha chosen inside every training set."""
    out = _ridge(t)
    return out.select("row", r6("target").alias("target"), F.round("predicted", 5).alias("predicted"), F.round("reference", 5).alias("reference"))


def _ridge(t: Tables) -> DataFrame:
    return evaluation.ridge_oof(population(t), ["log_words"], "log_chars")


@query(RIDGE_SQL + " SELECT round(1 - sum(pow(t - predicted, 2)) / sum(pow(t - reference, 2)), 5) AS r_squared, round(avg(abs(t - predicted)), 5) AS mae, round(avg(abs(t - reference)), 5) AS mae_mean FROM p")
def out_of_sample_fit(t: Tables) -> DataFrame:
    """Out-of-sample R-squared, and mean absolute error beside that of the training mean."""
    square = lambda c: F.sum(F.pow(F.col("target") - F.col(c), 2))
    error = lambda c: F.avg(F.abs(F.col("target") - F.col(c)))
    return _ridge(t).agg(F.round(1 - square("predicted") / square("reference"), 5).alias("r_squared"), F.round(error("predicted"), 5).alias("mae"), F.round(error("reference"), 5).alias("mae_mean"))
