"""Duplicate detection and independence groups on the document table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators import fingerprint as fp
from sigloom.plans.registry import Tables, query

MIN_CHARS = 20


def hashed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source", F.sha1("text").alias("h"))


def blocks(t: Tables) -> DataFrame:
    """Distinct (doc, line fingerprint) rows of the first copy of every text."""
    first = fp.keep_first(t.documents.select("doc_id", F.sha1("text").alias("h"), fp.text_blocks(F.col("text"), MIN_CHARS).alias("blocks")), "h", "doc_id")
    return first.select("doc_id", F.explode("blocks").alias("block"))


@query(
    """
WITH h AS (SELECT doc_id, sha1(text) AS h FROM documents), r AS (SELECT h, min(doc_id) AS rep FROM h GROUP BY h HAVING count(*) > 1)
SELECT r.rep AS a, h.doc_id AS b, 'identical' AS kind FROM h JOIN r ON h.h = r.h WHERE h.doc_id <> r.rep
"""
)
def content_hash_dups(t: Tables) -> DataFrame:
    return fp.identical_links(hashed(t), "h", "doc_id").withColumn("kind", F.lit("identical"))


@query(
    f"""
SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), x -> length(x) >= {MIN_CHARS})) AS INTEGER) AS n_blocks,
       CAST(len(list_distinct(list_transform(list_filter(string_split(text, chr(10)), x -> length(x) >= {MIN_CHARS}), x -> sha1(x)))) AS INTEGER) AS n_distinct,
       coalesce(list_min(list_transform(list_filter(string_split(text, chr(10)), x -> length(x) >= {MIN_CHARS}), x -> sha1(x))), '') AS smallest
FROM documents
""".replace("x -> ", "lambda x: ")
)
def record_hashes(t: Tables) -> DataFrame:
    long = F.filter(F.split("text", "\n"), lambda s: F.length(s) >= MIN_CHARS)
    b = fp.text_blocks(F.col("text"), MIN_CHARS)
    return t.documents.select("doc_id", F.size(long).alias("n_blocks"), F.size(b).alias("n_distinct"), F.coalesce(F.array_min(b), F.lit("")).alias("smallest"))


@query(
    "SELECT h, min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_copies FROM (SELECT doc_id, sha1(text) AS h FROM documents) GROUP BY h"
)
def dedup_first(t: Tables) -> DataFrame:
    return fp.keep_first(hashed(t).select("h", "doc_id"), "h", "doc_id").select("h", "doc_id", "n_copies")


GRAPH_SQL = f"""
WITH RECURSIVE h AS (SELECT doc_id, lang, sha1(text) AS h, text FROM documents),
rep AS (SELECT h, min(doc_id) AS rep FROM h GROUP BY h),
b AS (SELECT DISTINCT h.doc_id, sha1(l) AS k FROM h JOIN rep ON h.doc_id = rep.rep, unnest(string_split(h.text, chr(10))) u(l) WHERE length(l) >= {MIN_CHARS}),
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM b x JOIN b y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2 HAVING count(*) >= 2),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT rep.rep, h.doc_id FROM h JOIN rep ON h.h = rep.h UNION SELECT h.doc_id, rep.rep FROM h JOIN rep ON h.h = rep.h),
reach AS (SELECT doc_id AS n, doc_id AS m FROM documents UNION SELECT r.n, e.b FROM reach r JOIN e ON r.m = e.a),
root AS (SELECT n AS doc_id, min(m) AS root FROM reach GROUP BY n),
grp AS (SELECT doc_id, dense_rank() OVER (ORDER BY root) - 1 AS split_group, count(*) OVER (PARTITION BY root) AS group_size FROM root)
"""


def document_groups(t: Tables) -> DataFrame:
    """Independence groups: identical texts, or at least two shared informative lines."""
    edges = fp.identical_links(hashed(t), "h", "doc_id").union(fp.overlap_links(blocks(t), "doc_id", "block"))
    roots = fp.connected_components(t.documents, edges, "doc_id")
    return fp.dense_groups(roots, "doc_id")


@query(GRAPH_SQL + "SELECT doc_id, CAST(split_group AS BIGINT) AS split_group, CAST(group_size AS BIGINT) AS group_size FROM grp")
def components(t: Tables) -> DataFrame:
    return document_groups(t)


@query(
    GRAPH_SQL + """, c AS (SELECT split_group, count(DISTINCT lang) > 1 AS conflict FROM grp JOIN documents d ON grp.doc_id = d.doc_id GROUP BY 1)
SELECT grp.doc_id, CAST(CASE WHEN group_size > 1 THEN grp.split_group ELSE -1 END AS BIGINT) AS duplicate_set, group_size > 1 AND conflict AS condition_conflict FROM grp JOIN c ON grp.split_group = c.split_group"""
)
def duplicate_sets(t: Tables) -> DataFrame:
    groups = document_groups(t).join(t.documents.select("doc_id", "lang"), "doc_id")
    conflict = groups.groupBy("split_group").agg((F.countDistinct("lang") > 1).alias("conflict"))
    many = F.col("group_size") > 1
    return groups.join(conflict, "split_group").select(
        "doc_id", F.when(many, F.col("split_group")).otherwise(F.lit(-1).cast("long")).alias("duplicate_set"), (many & F.col("conflict")).alias("condition_conflict")
    )


@query(
    """
WITH h AS (SELECT doc_id, lang, sha1(text) AS h, doc_id = min(doc_id) OVER (PARTITION BY lang) AS rest FROM documents),
r AS (SELECT lang, h AS rh FROM h WHERE rest),
k AS (SELECT h.*, r.rh, min(CASE WHEN NOT rest THEN doc_id END) OVER (PARTITION BY h.lang, h.h) AS first FROM h JOIN r ON h.lang = r.lang)
SELECT doc_id, CASE WHEN rest AND first IS NOT NULL THEN 'same content as a task' WHEN NOT rest AND h = rh THEN 'same content as rest'
  WHEN NOT rest AND first < doc_id THEN 'duplicate of an earlier task' ELSE 'ok' END AS reason,
  NOT ((rest AND first IS NOT NULL) OR (NOT rest AND h = rh) OR (NOT rest AND first < doc_id)) AS usable FROM k
"""
)
def ambiguity_policy(t: Tables) -> DataFrame:
    rows = hashed(t).drop("source")
    rest = rows.groupBy("lang").agg(F.min("doc_id").alias("rest_id"))
    rows = rows.join(rest, "lang")
    return fp.resolve_ambiguous(rows, "lang", "doc_id", "h", F.col("doc_id") == F.col("rest_id")).select("doc_id", "reason", "usable")
