"""Control analyses of the nested procedure, on labelled documents and vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators import cycles, evaluation, features, nested, resample
from sigloom.plans.learning import FEAT_SQL, population
from sigloom.plans.registry import Tables, query, r6
from sigloom.plans.resampling import h32
from sigloom.plans.selection import GROUPED_SQL
from sigloom.plans.statistics import SCORED, scored

SINGLE = nested.Protocol("single", {"words": ("log_words",)}, (nested.Candidate(1.0, "control+somatoform", "words"),), calibrate=False)


def fits_sql(keys: str, penalty: str = "1") -> str:
    """CTEs behind train(keys, x, y): st with the moments and class weights, it with 25 Newton steps of balanced fits, best with the last."""
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    own = ", ".join(f"it.{k}" for k in keys.split(", "))
    return f"""st AS (SELECT {keys}, avg(x) AS mx, stddev_pop(x) AS sx, CAST(count(*) AS DOUBLE) AS n, CAST(sum(y) AS DOUBLE) AS np FROM train GROUP BY {keys}),
it AS (SELECT {keys}, 0 AS k, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM st UNION ALL
  SELECT {keys}, k + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT {keys}, k, a, b, {penalty} * a + sum(w * (p - y) * z) AS ga, sum(w * (p - y)) AS gb, {penalty} + sum(w * p * (1 - p) * z * z) AS haa, sum(w * p * (1 - p) * z) AS hab, sum(w * p * (1 - p)) AS hbb
        FROM (SELECT {own}, it.k, it.a, it.b, (x - mx) / sx AS z, y, CASE WHEN y = 1 THEN n / (2 * np) ELSE n / (2 * (n - np)) END AS w, 1 / (1 + exp(-(it.a * (x - mx) / sx + it.b))) AS p
              FROM it JOIN st ON {on("it", "st")} JOIN train ON {on("train", "it")}) GROUP BY {keys}, k, a, b) WHERE k < 25),
best AS (SELECT st.*, a, b FROM it JOIN st ON {on("it", "st")} WHERE k = 25)"""


@query(
    GROUPED_SQL.replace("log_words AS x, log_chars AS t", "log_chars AS t")
    + """, md AS (SELECT o, quantile_cont(t, 0.5) AS med FROM o JOIN g ON g.grp <> o GROUP BY o), train AS (SELECT o.o, coalesce(t, med) AS x, y FROM o JOIN md ON md.o = o.o JOIN g ON g.grp <> o.o),
""" + fits_sql("o") + " SELECT r AS row, round(1 / (1 + exp(-(a * (coalesce(t, med) - mx) / sx + b))), 6) AS p FROM g JOIN best ON best.o = g.grp JOIN md ON md.o = g.grp"
)
def diagnostic_oof(t: Tables) -> DataFrame:
    """Leave-one-group-out probabilities of a fixed model of one descriptor with gaps: medians, scales and fit from the training rows alone."""
    out = evaluation.fixed_oof(population(t), ["log_chars"])
    return out.select("row", r6("p").alias("p"))


POP_SQL = FEAT_SQL + """, g AS (SELECT f.doc_id AS r, CAST(regexp_extract(f.source, '(\\d+)', 1) AS BIGINT) AS grp, f.y, log_words AS x,
  CASE WHEN f.y = 1 THEN 'ptsd' WHEN l.toxic = 1 THEN 'somatoform' ELSE 'control_' || d.lang END AS stratum FROM f JOIN labels l ON l.doc_id = f.doc_id JOIN documents d ON d.doc_id = f.doc_id)"""
COMPARED = {"controls": ("control_en", "control_de", "control_fr", "control_es"), "somatoform": ("somatoform",)}


def _pairs_sql(negatives: tuple[str, ...], keys: str, src: str = "s") -> str:
    """AUC per key of the rows (keys, stratum, p) in ``src`` by ranks."""
    names = ", ".join(f"'{n}'" for n in negatives)
    over = f"PARTITION BY {keys}" if keys else ""
    return f"""SELECT {keys + "," if keys else ""} (sum(ar) FILTER (WHERE hit) - max(np) * (max(np) + 1) / CAST(2 AS DOUBLE)) / nullif(max(np) * max(nn), 0) AS auc FROM (
  SELECT *, rank() OVER ({over} ORDER BY p) + (count(*) OVER (PARTITION BY {keys + "," if keys else ""} p) - 1) / CAST(2 AS DOUBLE) AS ar, CAST(count(*) FILTER (WHERE hit) OVER ({over}) AS DOUBLE) AS np,
    CAST(count(*) FILTER (WHERE NOT hit) OVER ({over}) AS DOUBLE) AS nn FROM (SELECT *, stratum = 'ptsd' AS hit FROM {src} WHERE stratum = 'ptsd' OR stratum IN ({names}))) {"GROUP BY " + keys if keys else ""}"""


@query(
    POP_SQL + f""", c AS (SELECT grp, string_agg(concat_ws(':', stratum, n), ',' ORDER BY concat_ws(':', stratum, n)) AS shape FROM (SELECT grp, stratum, count(*) AS n FROM g GROUP BY ALL) GROUP BY grp),
dealt AS (SELECT rep, grp, (row_number() OVER (PARTITION BY rep ORDER BY md5(shape), {h32("CAST(42 + rep AS VARCHAR)", "grp")}, grp) - 1) % 5 AS fold FROM c CROSS JOIN range(0, 5) r(rep)),
cut AS (SELECT DISTINCT rep, fold FROM dealt), train AS (SELECT cut.rep, cut.fold, x, y FROM cut JOIN dealt ON dealt.rep = cut.rep AND dealt.fold <> cut.fold JOIN g ON g.grp = dealt.grp),
""" + fits_sql("rep, fold") + f""", s AS (SELECT d.rep, d.fold, g.stratum, round(1 / (1 + exp(-(a * (x - mx) / sx + b))), 12) AS p FROM g JOIN dealt d ON d.grp = g.grp JOIN best ON best.rep = d.rep AND best.fold = d.fold)
SELECT CAST(cut.rep AS INTEGER) AS "repeat", CAST(cut.fold AS BIGINT) AS fold, round(u.auc, 6) AS controls, round(v.auc, 6) AS somatoform FROM cut
  LEFT JOIN ({_pairs_sql(COMPARED["controls"], "rep, fold")}) u ON u.rep = cut.rep AND u.fold = cut.fold LEFT JOIN ({_pairs_sql(COMPARED["somatoform"], "rep, fold")}) v ON v.rep = cut.rep AND v.fold = cut.fold"""
)
def fold_areas(t: Tables) -> DataFrame:
    """Areas inside the test folds of five repeated, grouped five-fold runs."""
    out = evaluation.fold_aucs(population(t), SINGLE, COMPARED)
    return out.select("repeat", "fold", r6("controls").alias("controls"), r6("somatoform").alias("somatoform"))


HELD_OUT = "control_es"


@query(
    POP_SQL + f""", o AS (SELECT DISTINCT grp AS o FROM g UNION ALL SELECT -1), sets AS (SELECT o, inside, grp, x, y, stratum FROM o JOIN g ON g.grp <> o CROSS JOIN (VALUES (0), (1)) q(inside) WHERE inside = 1 OR stratum <> '{HELD_OUT}'),
train AS (SELECT o, inside, x, y FROM sets), """ + fits_sql("o, inside") + f""", s1 AS (SELECT g.stratum, inside, round(1 / (1 + exp(-(a * (x - mx) / sx + b))), 12) AS p FROM g JOIN best ON best.o = CASE WHEN inside = 0 AND g.stratum = '{HELD_OUT}' THEN -1 ELSE g.grp END),
unseen AS (SELECT * FROM s1 WHERE inside = 0), seen AS (SELECT * FROM s1 WHERE inside = 1)
SELECT (SELECT count(*) FROM g WHERE stratum = '{HELD_OUT}') AS n, round(({_pairs_sql((HELD_OUT,), "", "unseen")}), 6) AS auc_unseen, round(({_pairs_sql((HELD_OUT,), "", "seen")}), 6) AS auc_in_training,
  round((SELECT avg(CAST(p >= 0.5 AS INTEGER)) FROM unseen WHERE stratum = '{HELD_OUT}'), 6) AS share_p_ge_05_unseen, round((SELECT avg(CAST(p >= 0.5 AS INTEGER)) FROM seen WHERE stratum = '{HELD_OUT}'), 6) AS share_p_ge_05_in_training"""
)
def unseen_stratum(t: Tables) -> DataFrame:
    """Cases against one control stratum that no fit has seen, beside the same area with it in training."""
    rows = population(t)
    out = evaluation.unseen_batch(rows, SINGLE, nested.nested_oof(rows, SINGLE), HELD_OUT)
    return out.select("n", *[r6(c).alias(c) for c in ("auc_unseen", "auc_in_training", "share_p_ge_05_unseen", "share_p_ge_05_in_training")])


INSIDE = ("ptsd", "control_A")


@query(
    SCORED + f""", b AS (SELECT *, doc_id // 20 AS block FROM scored), part AS (SELECT DISTINCT block FROM b WHERE stratum IN ('ptsd', 'control_A')),
fr AS (SELECT block, arg_min(stratum, doc_id) AS stratum, arg_min(y, doc_id) AS y FROM b WHERE block IN (FROM part) GROUP BY block), seat AS (SELECT block, row_number() OVER (ORDER BY block) - 1 AS idx FROM fr),
don AS (SELECT perm, stratum, y, row_number() OVER (PARTITION BY perm ORDER BY {h32("'42-' || perm", "block")}, block) - 1 AS idx FROM fr CROSS JOIN range(0, 20) q(perm))
SELECT CAST(don.perm AS INTEGER) AS perm, seat.block, don.stratum, don.y FROM seat JOIN don ON seat.idx = don.idx"""
)
def permuted_within(t: Tables) -> DataFrame:
    """Label pairs moved between the blocks that have a row of two strata; other blocks keep theirs."""
    rows = scored(t).withColumn("block", F.floor(F.col("doc_id") / 20))
    return resample.permuted_labels(rows, "block", "doc_id", ["stratum", "y"], 20, inside=F.col("stratum").isin(*INSIDE)).select("perm", "block", "stratum", "y")


@query(
    """WITH e AS (SELECT label, vec_id % 3 AS ch, vec_id // 3 % 2 AS half, i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings CROSS JOIN range(0, 64) r(i)),
m AS (SELECT label, ch, half, i, avg(v) AS v FROM e GROUP BY ALL), c AS (SELECT label, ch, half, avg(v) AS dc, avg(CASE WHEN i % 2 = 0 THEN v ELSE -v END) AS ny FROM m GROUP BY ALL),
z AS (SELECT m.label, m.ch, m.half, i, v - dc - CASE WHEN i % 2 = 0 THEN ny ELSE -ny END AS v FROM m JOIN c ON c.label = m.label AND c.ch = m.ch AND c.half = m.half)
SELECT a.label, CASE a.ch WHEN 0 THEN 'Fp1' WHEN 1 THEN 'Fp2' ELSE 'O1' END AS channel, round(sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)), 6) + 0.0 AS r
FROM z a JOIN z b ON a.label = b.label AND a.ch = b.ch AND a.i = b.i AND a.half = 0 AND b.half = 1 GROUP BY a.label, a.ch"""
)
def channel_halves(t: Tables) -> DataFrame:
    """Correlation of the even and odd mean cycles per label and channel, from the bins between mean and Nyquist."""
    channel = F.get(F.array(F.lit("Fp1"), F.lit("Fp2"), F.lit("O1")), (F.col("vec_id") % 3).cast("int"))
    rows = t.embeddings.select(F.col("label").alias("path"), channel.alias("channel"), F.floor(F.col("vec_id") / 3).alias("cycle"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    out = cycles.channel_correlations(cycles.half_spectra(rows), np.arange(1, 32))
    return out.filter("r IS NOT NULL").select(F.col("path").alias("label"), "channel", r6("r").alias("r"))


@query(
    """WITH d AS (SELECT doc_id // 5 AS block, doc_id % 5 + 1 AS trial, CASE WHEN doc_id // 5 % 4 = 0 THEN CAST(40 AS DOUBLE) ELSE n_chars / CAST(10 AS DOUBLE) END AS v FROM documents WHERE doc_id % 11 <> 0),
b AS (SELECT block, count(*) AS n, count(*) >= 2 AND max(v) = min(v) AS same, max(log10(v)) FILTER (WHERE trial = 1) AS first, avg(log10(v)) AS mean, regr_slope(log10(v), CAST(trial AS DOUBLE)) AS slope,
  avg(log10(v)) FILTER (WHERE trial > 1) AS later, max(v) FILTER (WHERE trial = 1) AS t1, sum(v) AS total FROM d GROUP BY block)
SELECT block, round(CASE WHEN NOT same THEN first END, 6) AS beh_log_duration_trial1, round(CASE WHEN NOT same AND n = 5 THEN mean END, 6) AS beh_log_duration_mean, round(CASE WHEN NOT same AND n = 5 THEN slope END, 6) + 0.0 AS beh_log_duration_slope,
  round(CASE WHEN NOT same AND n = 5 THEN first - later END, 6) + 0.0 AS beh_first_trial_excess, CAST(same AS DOUBLE) AS beh_templated, round(CASE WHEN NOT same THEN t1 END, 6) AS trial1_s,
  round(CASE WHEN NOT same AND n = 5 THEN total END, 6) AS total_s, CASE WHEN same THEN CAST(0 AS DOUBLE) ELSE CAST(n AS DOUBLE) END AS n_trials FROM b"""
)
def behaviour_table(t: Tables) -> DataFrame:
    """Solve times of five trials a block: some trials are missing, some blocks are templates of equal times."""
    block = F.floor(F.col("doc_id") / 5)
    d = F.when(F.col("doc_id") % 11 != 0, F.when(block % 4 == 0, 40.0).otherwise(F.col("n_chars") / 10))
    rows = t.documents.select(block.alias("block"), (F.col("doc_id") % 5 + 1).alias("trial"), d.alias("active_duration_s"))
    out = features.behaviour_features(rows, "block")
    return out.select("block", *[c if c in ("beh_templated", "n_trials") else r6(c).alias(c) for c in out.columns if c != "block"])
