"""Leave-one-group-out, bootstrap and permutation queries on scored documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators import folds, metrics, ordered, replicates, resample
from sigloom.plans.registry import Tables, query, r6
from sigloom.plans.statistics import SCORED, is_ptsd, scored

B = resample.N_BOOTSTRAP
PERMUTATIONS = 100


def h32(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


@query(
    SCORED + """, g AS (SELECT source, sum(p) AS s, count(*) AS n FROM scored GROUP BY source)
SELECT source, CAST(n AS BIGINT) AS n_test, CAST((SELECT sum(n) FROM g) - n AS BIGINT) AS n_train, round(((SELECT sum(s) FROM g) - s) / ((SELECT sum(n) FROM g) - n), 6) AS train_mean FROM g
"""
)
def logo_mean(t: Tables) -> DataFrame:
    out = resample.leave_group_out_mean(scored(t), "source", "p")
    return out.select("source", "n_test", "n_train", r6("train_mean").alias("train_mean"))


def _mixed(src: str) -> str:
    """SQL: ``src`` with its 31-bit column x mixed."""
    keep = "* EXCLUDE (x)"
    (a, b), (s, t, u) = replicates.FACTORS, replicates.SHIFTS
    for step in (f"xor(x, x >> {s})", f"(x * {a}) & {replicates.BITS}", f"xor(x, x >> {t})", f"(x * {b}) & {replicates.BITS}", f"xor(x, x >> {u})"):
        src = f"(SELECT {keep}, {step} AS x FROM {src})"
    return src


def _picks(ix: str, *keys: str) -> str:
    """SQL: one row per slot of ``ix`` and replicate with the drawn index ``pick``; ``keys`` seed the draws."""
    seed = "'42'"
    base = f"(SELECT *, (({h32(seed, *keys)} & {replicates.BITS}) + rep) & {replicates.BITS} AS x FROM (SELECT DISTINCT {', '.join(keys)} FROM {ix}) CROSS JOIN range(0, {B}) r(rep))"
    first = f"(SELECT *, x AS r1 FROM {_mixed(base)})"
    second = f"(SELECT * EXCLUDE (x), x AS r2 FROM {_mixed(f'(SELECT * REPLACE (xor(x, {replicates.SECOND}) & {replicates.BITS} AS x) FROM {first})')})"
    slots = f"(SELECT s.*, i.n, (r1 + i.idx) & {replicates.BITS} AS x FROM {second} s JOIN {ix} i USING ({', '.join(keys)}))"
    last = _mixed(f"(SELECT * REPLACE (xor(x, r2) AS x) FROM {_mixed(slots)})")
    return f"(SELECT *, x % n AS pick FROM {last})"


def _draws(src: str, cls: str) -> str:
    """Multiplicities per (cls, rep, source) of the rows in ``src``."""
    return f"""
k AS (SELECT DISTINCT {cls} AS cls, source FROM {src}), ix AS (SELECT cls, source, row_number() OVER (PARTITION BY cls ORDER BY source) - 1 AS idx, count(*) OVER (PARTITION BY cls) AS n FROM k),
dr AS (SELECT cls, rep, pick FROM {_picks('ix', 'cls')}),
mult AS (SELECT dr.cls, dr.rep, ix.source, count(*) AS m FROM dr JOIN ix ON dr.cls = ix.cls AND dr.pick = ix.idx GROUP BY 1, 2, 3)"""


def _weighted_auc(score: str, name: str) -> str:
    """AUC per rep from weighted rows w(rep, cls, s, m)."""
    return f"""
{name}w AS (SELECT rep, {score} AS s, sum(CASE WHEN cls = 'pos' THEN m ELSE 0 END) AS wp, sum(CASE WHEN cls = 'neg' THEN m ELSE 0 END) AS wn
  FROM labelled l JOIN mult USING (cls, source) GROUP BY 1, 2),
{name} AS (SELECT rep, CAST(sum(wp * (below + CAST(0.5 AS DOUBLE) * wn)) AS DOUBLE) / (sum(wp) * sum(wn)) AS {name} FROM
  (SELECT *, coalesce(sum(wn) OVER (PARTITION BY rep ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {name}w) GROUP BY rep)"""


LABELLED = ", labelled AS (SELECT *, CASE WHEN y = 1 THEN 'pos' ELSE 'neg' END AS cls, n_chars % 97 AS other FROM scored)"


def _auc_of(score: str) -> str:
    return f"(SELECT sum(CASE WHEN a.{score} > b.{score} THEN CAST(1 AS DOUBLE) WHEN a.{score} = b.{score} THEN 0.5 ELSE 0 END) / count(*) FROM labelled a JOIN labelled b ON a.cls = 'pos' AND b.cls = 'neg')"


@query(
    SCORED + LABELLED + "," + _draws("labelled", "cls") + "," + _weighted_auc("p", "auc")
    + f" SELECT round({_auc_of('p')}, 6) AS value, round(quantile_cont(auc, 0.025), 6) AS ci_low, round(quantile_cont(auc, 0.975), 6) AS ci_high FROM auc"
)
def group_bootstrap(t: Tables) -> DataFrame:
    out = resample.auc_with_ci(scored(t), [], "source", "p", F.col("y") == 1, B)
    return out.select(*[r6(c).alias(c) for c in ("value", "ci_low", "ci_high")])


@query(
    SCORED + LABELLED + "," + _draws("labelled", "cls") + "," + _weighted_auc("p", "a") + "," + _weighted_auc("other", "b")
    + f" SELECT round({_auc_of('p')} - {_auc_of('other')}, 6) AS value, round(quantile_cont(a - b, 0.025), 6) AS ci_low, round(quantile_cont(a - b, 0.975), 6) AS ci_high FROM a JOIN b USING (rep)"
)
def paired_diff(t: Tables) -> DataFrame:
    rows = scored(t).withColumn("other", F.col("n_chars") % 97)
    out = resample.paired_auc_difference(rows, [], "source", "p", "other", F.col("y") == 1, B)
    return out.select(*[r6(c).alias(c) for c in ("value", "ci_low", "ci_high")])


@query(
    SCORED + ", rows AS (SELECT *, CASE WHEN p >= 0.5 THEN CAST(1 AS DOUBLE) ELSE 0 END AS hit FROM scored WHERE stratum <> 'ptsd')," + _draws("rows", "stratum")
    + """, c AS (SELECT stratum AS cls, source, sum(hit) AS h, count(*) AS n FROM rows GROUP BY 1, 2),
r AS (SELECT cls, rep, sum(m * h) / sum(m * n) AS fpr FROM c JOIN mult USING (cls, source) GROUP BY 1, 2),
v AS (SELECT stratum AS cls, avg(hit) AS v FROM rows GROUP BY 1)
SELECT r.cls AS stratum, round(1 - max(v), 6) AS value, round(1 - quantile_cont(fpr, 0.975), 6) + 0.0 AS ci_low, round(1 - quantile_cont(fpr, 0.025), 6) + 0.0 AS ci_high FROM r JOIN v ON r.cls = v.cls GROUP BY r.cls
"""
)
def specificity_ci(t: Tables) -> DataFrame:
    """Specificity per stratum: one minus the false-positive share, interval ends swapped."""
    rows = scored(t).filter(~is_ptsd())
    out = resample.rate_with_ci(rows, ["stratum"], "source", F.col("p") >= 0.5, B)
    return out.select("stratum", r6(1 - F.col("value")).alias("value"), r6(1 - F.col("ci_high")).alias("ci_low"), r6(1 - F.col("ci_low")).alias("ci_high"))


def _permuted(n: int) -> str:
    return f"""
fr AS (SELECT source, arg_min(stratum, doc_id) AS stratum, arg_min(y, doc_id) AS y FROM scored GROUP BY source),
seat AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS idx FROM fr),
don AS (SELECT perm, stratum, y, row_number() OVER (PARTITION BY perm ORDER BY {h32("'42-' || perm", "source")}, source) - 1 AS idx FROM fr CROSS JOIN range(0, {n}) q(perm)),
moved AS (SELECT don.perm, seat.source, don.stratum, don.y FROM seat JOIN don ON seat.idx = don.idx)"""


@query(SCORED + "," + _permuted(5) + " SELECT CAST(perm AS INTEGER) AS perm, source, stratum, y FROM moved")
def permute_labels(t: Tables) -> DataFrame:
    """Label pairs moved between groups, each pair kept intact."""
    return resample.permuted_labels(scored(t), "source", "doc_id", ["stratum", "y"], 5).select("perm", "source", "stratum", "y")


@query(
    SCORED + "," + _permuted(PERMUTATIONS) + """, u AS (SELECT m.perm AS g, s.p AS s, m.y FROM scored s JOIN moved m ON s.source = m.source),
n AS (SELECT g, (sum(ar) FILTER (WHERE y = 1) - max(np) * (max(np) + 1) / CAST(2 AS DOUBLE)) / (max(np) * max(nn)) AS auc
  FROM (SELECT g, y, rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / CAST(2 AS DOUBLE) AS ar,
        CAST(count(*) FILTER (WHERE y = 1) OVER (PARTITION BY g) AS DOUBLE) AS np, CAST(count(*) FILTER (WHERE y = 0) OVER (PARTITION BY g) AS DOUBLE) AS nn FROM u) GROUP BY g HAVING max(np) > 0 AND max(nn) > 0)
SELECT CAST(count(*) AS BIGINT) AS n_permutations, round(avg(n.auc), 6) AS null_mean, round(quantile_cont(n.auc, 0.95), 6) AS null_q95,
       round(max(o.auc), 6) AS observed, round((1 + count(*) FILTER (WHERE n.auc >= o.auc)) / CAST(1 + count(*) AS DOUBLE), 6) AS p_value
FROM n CROSS JOIN (SELECT round(CAST(sum(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS DOUBLE) / count(*), 12) AS auc FROM scored a JOIN scored b ON a.y = 1 AND b.y = 0) o
"""
)
def permutation_null(t: Tables) -> DataFrame:
    """Null distribution of an AUC under labels permuted between groups."""
    rows = scored(t).select("source", "p")
    observed = ordered.auc(scored(t), [], "p", F.col("y") == 1).select(F.round("auc", 12).alias("observed"))  # one number
    moved = resample.permuted_labels(scored(t), "source", "doc_id", ["stratum", "y"], PERMUTATIONS)
    null = ordered.auc(rows.join(moved, "source"), ["perm"], "p", F.col("y") == 1).filter("auc IS NOT NULL")
    q = ordered.quantiles(null, [], "auc", {"null_q95": 0.95})
    null = null.crossJoin(F.broadcast(observed))
    agg = null.agg(
        F.count(F.lit(1)).alias("n_permutations"), r6(F.avg("auc")).alias("null_mean"), r6(F.max("observed")).alias("observed"), r6(resample.permutation_p(F.col("observed"), F.col("auc"))).alias("p_value")
    )
    return agg.crossJoin(F.broadcast(q)).select("n_permutations", "null_mean", r6("null_q95").alias("null_q95"), "observed", "p_value")


@query(
    f"""SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CAST(i % 5 AS INTEGER) AS fold FROM (SELECT c_custkey, row_number() OVER (ORDER BY md5(shape), {h32("'42'", "c_custkey")}, c_custkey) - 1 AS i FROM
 (SELECT c_custkey, string_agg(concat_ws(':', st, n), ',' ORDER BY concat_ws(':', st, n)) AS shape FROM (SELECT o_custkey AS c_custkey, o_orderstatus AS st, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1))"""
)
def group_folds(t: Tables) -> DataFrame:
    """Stratified group folds: customers are the groups, order status the label."""
    rows = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return folds.stratified_group_folds(rows, "c_custkey", "o_orderstatus", 5, 42).select("c_custkey", "fold")


SPECIFIC_SQL = f""", f AS (SELECT doc_id, stratum, 'length' AS feature, CAST(n_chars AS DOUBLE) AS v FROM scored UNION ALL SELECT doc_id, stratum, 'remainder', CAST(n_chars % 97 AS DOUBLE) FROM scored),
rows AS (SELECT 'pc' AS part, doc_id, feature, v, CASE WHEN stratum = 'ptsd' THEN 'pos' ELSE 'neg' END AS cls FROM f WHERE stratum = 'ptsd' OR stratum LIKE 'control@_%' ESCAPE '@'
  UNION ALL SELECT 'sc', doc_id, feature, v, CASE WHEN stratum = 'somatoform' THEN 'pos' ELSE 'neg' END FROM f WHERE stratum IN ('somatoform', 'control_A')
  UNION ALL SELECT 'ps', doc_id, feature, v, CASE WHEN stratum = 'ptsd' THEN 'pos' ELSE 'neg' END FROM f WHERE stratum IN ('ptsd', 'somatoform')),
ix AS (SELECT part, feature, cls, doc_id, row_number() OVER (PARTITION BY part, feature, cls ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY part, feature, cls) AS n FROM rows),
dr AS (SELECT part, feature, cls, rep, pick FROM (SELECT p.*, 'pc' AS part FROM {_picks("(SELECT * FROM ix WHERE part = 'pc')", "feature", "cls")} p
  UNION ALL SELECT p.*, 'sc' FROM {_picks("(SELECT * FROM ix WHERE part = 'sc')", "feature", "cls")} p UNION ALL SELECT p.*, 'ps' FROM {_picks("(SELECT * FROM ix WHERE part = 'ps')", "feature", "cls")} p)),
mult AS (SELECT dr.part, dr.feature, dr.cls, ix.doc_id, dr.rep, count(*) AS m FROM dr JOIN ix ON dr.part = ix.part AND dr.feature = ix.feature AND dr.cls = ix.cls AND dr.pick = ix.idx GROUP BY ALL
  UNION ALL SELECT part, feature, cls, doc_id, -1, 1 FROM ix),
w AS (SELECT part, feature, rep, v, coalesce(sum(m) FILTER (WHERE cls = 'pos'), 0) AS wp, coalesce(sum(m) FILTER (WHERE cls = 'neg'), 0) AS wn FROM rows JOIN mult USING (part, feature, cls, doc_id) GROUP BY ALL),
a AS (SELECT part, feature, rep, CAST(sum(wp * (below + CAST(0.5 AS DOUBLE) * wn)) AS DOUBLE) / (sum(wp) * sum(wn)) AS auc
  FROM (SELECT *, coalesce(sum(wn) OVER (PARTITION BY part, feature, rep ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM w) GROUP BY ALL),
q AS (SELECT part, feature, max(auc) FILTER (WHERE rep < 0) AS value, quantile_cont(auc, 0.025) FILTER (WHERE rep >= 0) AS lo, quantile_cont(auc, 0.975) FILTER (WHERE rep >= 0) AS hi FROM a GROUP BY ALL),
z AS (SELECT feature, max(value) FILTER (WHERE part = 'pc') AS pc, max(value) FILTER (WHERE part = 'sc') AS sc, max(value) FILTER (WHERE part = 'ps') AS ps,
  bool_or(lo > 0.5 OR hi < 0.5) FILTER (WHERE part = 'pc') AS pc_off, bool_or(lo > 0.5 OR hi < 0.5) FILTER (WHERE part = 'ps') AS ps_off FROM q GROUP BY feature)
SELECT feature, round(pc, 6) AS auc_pc, round(sc, 6) AS auc_sc, round(ps, 6) AS auc_ps,
  CASE WHEN pc_off AND (pc - 0.5) * (sc - 0.5) > 0 AND abs(sc - 0.5) >= 0.5 * abs(pc - 0.5) THEN 'shared with somatoform' WHEN pc_off OR ps_off THEN 'specific to PTSD' ELSE 'no difference' END AS verdict FROM z"""


@query(SCORED + SPECIFIC_SQL)
def disorder_specificity(t: Tables) -> DataFrame:
    """Per feature: case against controls, other disorder against controls of its own format, case against other, and the verdict.

    Subjects (documents) are drawn within their class.
    """
    rows = scored(t).select(
        "doc_id", "stratum", F.explode(F.array(
            F.struct(F.lit("length").alias("feature"), F.col("n_chars").cast("double").alias("v")),
            F.struct(F.lit("remainder").alias("feature"), (F.col("n_chars") % 97).cast("double").alias("v")),
        )).alias("f"),
    ).select("doc_id", "stratum", "f.*")
    case, other, ctrl = is_ptsd(), F.col("stratum") == "somatoform", F.col("stratum").startswith("control_")
    same_format = F.col("stratum") == "control_A"
    parts = [("pc", F.when(case, True).when(ctrl, False)), ("sc", F.when(other, True).when(same_format, False)), ("ps", F.when(case, True).when(other, False))]
    table = None
    for name, label in parts:
        out = resample.auc_with_ci(rows, ["feature"], "doc_id", "v", label, B)
        out = out.select("feature", *[F.col(c).alias(f"{name}_{c}") for c in ("value", "ci_low", "ci_high")])
        table = out if table is None else table.join(out, "feature")
    verdict = resample.specificity_verdict(*[F.col(c) for c in ("pc_value", "pc_ci_low", "pc_ci_high", "sc_value", "ps_ci_low", "ps_ci_high")])
    return table.select("feature", *[r6(f"{n}_value").alias(f"auc_{n}") for n, _ in parts], verdict.alias("verdict"))


@query(
    SCORED + LABELLED + "," + _draws("labelled", "cls") + "," + _weighted_auc("p", "auc")
    + f", ci AS (SELECT {_auc_of('p')} AS value, quantile_cont(auc, 0.025) AS lo, quantile_cont(auc, 0.975) AS hi FROM auc) "
    "SELECT round(30 * greatest(0, (value - 0.5) / 0.5), 6) + 0.0 AS points, round(30 * greatest(0, (lo - 0.5) / 0.5), 6) + 0.0 AS points_low, "
    "round(30 * greatest(0, (hi - 0.5) / 0.5), 6) + 0.0 AS points_high FROM ci"
)
def score_points(t: Tables) -> DataFrame:
    """Points of an AUC and of the ends of its interval."""
    out = resample.auc_with_ci(scored(t), [], "source", "p", F.col("y") == 1, B)
    names = (("value", "points"), ("ci_low", "points_low"), ("ci_high", "points_high"))
    return out.select(*[r6(metrics.points(F.col(c), 30.0)).alias(n) for c, n in names])


@query(
    SCORED + """SELECT lang, round(0.5 * (avg(CASE WHEN y = 1 THEN CASE WHEN n_chars >= 500 THEN CAST(1 AS DOUBLE) ELSE 0 END END)
  + avg(CASE WHEN y = 0 THEN CASE WHEN n_chars < 500 THEN CAST(1 AS DOUBLE) ELSE 0 END END)), 6) AS auc FROM scored GROUP BY lang"""
)
def rule_auc(t: Tables) -> DataFrame:
    """AUC of a yes/no rule, which equals its balanced accuracy."""
    rows = scored(t).withColumn("rule", (F.col("n_chars") >= 500).cast("int"))
    return ordered.auc(rows, ["lang"], "rule", F.col("y") == 1).select("lang", r6("auc").alias("auc"))
