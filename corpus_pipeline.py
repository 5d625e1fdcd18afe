"""Corpus pipeline: reject poor documents, keep one of each group of near copies, redact personal data, pack into sequences.

Every stage takes what its predecessor wrote. All but the last return the columns of the documents; the last returns the
places of the packed pieces. A row without an id cannot be a copy of another and is kept. Extra columns of the documents
pass through the first three stages unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import line_crf, linear_pack, pii_boost, signature_tree
from sigloom.llm.common import small_batches, stored
from sigloom.session import load, ship_package

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
# the first stage is a fitted model and the last a packing plan, which SQL cannot express
ORACLE_SQL = None
FIRST_NUMBER = 1 << 62
FEW_IDS = 100_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that the line model rejects go."""
    model = line_crf.train(docs, load(spark, sf_dir, "labels"))
    taken = docs.select([F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)] + [F.col("text")])
    scored = line_crf.score_documents(taken, model, [f"_c{i}" for i in range(len(docs.columns))])
    return scored.filter("predicted = 1").select([F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group of linked documents the one with the smallest id stays, in one row.

    Different texts under one id are different documents: all but the one with the least digest take part under a number of
    their own, beyond all ids.
    """
    base = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("number"), "text", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    ids = base.filter("number IS NOT NULL").groupBy("number").agg(F.min("digest").alias("first"), F.max("digest").alias("last"))
    several = stored(ids.filter("first <> last").select("number", "first"), "several")
    n = several.count()
    if n:
        own = F.lit(FIRST_NUMBER) + F.pmod(F.xxhash64("number", "digest"), F.lit(FIRST_NUMBER))
        base = base.join(F.broadcast(several) if n <= FEW_IDS else several, "number", "left").withColumn("number", F.when(F.col("first") != F.col("digest"), own).otherwise(F.col("number")))
    groups = stored(signature_tree.near_duplicates(base.select(F.col("number").alias("doc_id"), "text")), "groups")
    # one row a document; texts are shuffled once, and again only where one text has several rows
    state = stored(groups.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("number")).agg(F.bool_or(F.col("component_id") != F.col("doc_id")).alias("gone"), F.count(F.lit(1)).alias("n")), "state")
    # states grow with the documents, so this join is never a broadcast
    kept = base.select("row", "number").join(state.hint("merge"), "number", "left").filter("gone IS NULL OR NOT gone")
    if state.filter("n > 1").isEmpty():
        return kept.select("row.*")
    single = kept.filter("n IS NULL OR n = 1").select("row")
    one = kept.filter("n > 1").groupBy("number").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return single.unionByName(one.select("row")).select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: spans of personal data give way to the name of their kind."""
    clean = pii_boost.redact(docs, pii_boost.train(docs))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return clean.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: pieces of at most 4096 tokens with their sequence and offset."""
    return linear_pack.pack_documents(docs, TOKENIZER, END_ID)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _ready(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", _ready(quality)),
    ("near_duplicates", _ready(near_copies)),
    ("personal_data", _ready(personal_data)),
    ("best_fit_packing", _ready(packing)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written and read again."""
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
