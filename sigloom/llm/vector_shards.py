"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Equal texts form a group with one vector (bytes, tokens, rows), each as a share of the total. A group goes to the shard
where the dot product of its vector with the shard's residual capacity is highest, largest groups first. Law: ``bytes``
(shard sizes are near equal).

Groups of more than ``1 / (shards * PARTS)`` of a total are cut into fragments by row hash, so no group is bound to one
shard or task; their number is bounded by that share. Items of more than ``1 / (shards * LARGE)`` are placed first, all in
one place: again a bounded number. The rest is dealt by hash into blocks of bounded row count; every block runs the same
greedy placement against its part of what the large items left, so blocks are independent and the whole stays balanced.

Defined cases: a null text has size 8 and no tokens, and groups with the empty text; ties go to the lowest shard; repeated
rows are rows of one group, and null ids are ordinary rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import ranked_within, salts_for, stored, whole_text

SHARDS = 24
PARTS = 8
LARGE = 64
BLOCK_ITEMS = 32_768
ROW_BYTES = 8
DIMENSIONS = ("bytes", "tokens", "rows")
#: weights in the dot product; the law is about bytes
WEIGHTS = np.array([4.0, 1.0, 0.5])


def measured(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``size`` (UTF-8 bytes and 8), ``tokens`` (blank-separated), ``text_crc32``, ``digest``."""
    text = whole_text()
    blanks = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.when(text == "", 0).otherwise(blanks + 1).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("digest"),
    )


def place(items: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shard of each vector, in the given order; ``residual`` (shards, 3) is used up."""
    out = np.zeros(len(items), np.int32)
    for i, v in enumerate(items):
        j = int((residual @ (WEIGHTS * v)).argmax())
        residual[j] -= v
        out[i] = j
    return out


def _vectors(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))


def assign(rows: DataFrame, shards: int = SHARDS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Adds ``shard`` to measured rows (read several times: write them first)."""
    groups = stored(_vectors(rows, "digest"), "groups")
    total = groups.agg(F.count(F.lit(1)).alias("n"), *[F.greatest(F.coalesce(F.sum(d), F.lit(0)), F.lit(1)).alias(d) for d in DIMENSIONS]).first()
    share = F.greatest(*[F.col(d) / F.lit(float(total[d])) for d in DIMENSIONS])
    # at most 3 * shards * PARTS groups
    cut = groups.filter(share > 1 / (shards * PARTS)).select("digest", F.ceil(share * shards * PARTS).cast("int").alias("parts"))
    fragment = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), F.lit(0))
    rows = rows.join(F.broadcast(cut), "digest", "left").withColumn("fragment", fragment).drop("parts")

    blocks = max(1, -(-total["n"] // block_items))
    items = _vectors(rows, "digest", "fragment").withColumn("share", share).withColumn("block", F.pmod(F.xxhash64("digest", "fragment"), F.lit(blocks)).cast("int"))
    items = stored(items, "items")
    scale = np.array([total[d] for d in DIMENSIONS], float)
    limit = 1 / (shards * LARGE)
    large = items.filter(F.col("share") > limit).orderBy(F.desc("share"), "digest", "fragment").collect()  # at most 3 * shards * LARGE items
    residual = np.full((shards, len(DIMENSIONS)), 1 / shards)
    first = place(np.array([[r[d] for d in DIMENSIONS] for r in large], float).reshape(-1, 3) / scale, residual)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, left = None, None
        for batch in batches:
            vectors = np.stack([batch.column(d).to_numpy() for d in DIMENSIONS], axis=1) / scale
            which = batch.column("block").to_numpy()
            shard = np.zeros(len(which), np.int32)
            for b in np.unique(which):
                if b != block:
                    block, left = b, residual / blocks
                at = np.flatnonzero(which == b)
                shard[at] = place(vectors[at], left)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("fragment"), pa.array(shard)], names=["digest", "fragment", "shard"])

    small = items.filter(F.col("share") <= limit).repartition(blocks, "block").sortWithinPartitions("block", F.desc("share"), "digest", "fragment")
    placed = small.mapInArrow(run, "digest binary, fragment int, shard int")
    if large:
        known = [(r["digest"], r["fragment"], int(s)) for r, s in zip(large, first, strict=True)]
        placed = placed.unionByName(items.sparkSession.createDataFrame(known, "digest binary, fragment int, shard int"))
    return rows.join(stored(placed, "placed"), ["digest", "fragment"])


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``; slots count from 0 within a shard."""
    known = stored(measured(docs), "measured")
    rows = assign(known, shards)
    slots = ranked_within(rows, "shard", ["doc_id", "text_crc32", "size"], salts_for(known.count() // shards))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("_rank").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
