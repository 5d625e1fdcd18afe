"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A text is a multiset of short paragraphs: runs of up to three words within a line with the white space behind them, so
the pieces cover every character. Each is hashed to a wide vector; a fingerprint is the sum of the vectors:

* ``sums``: four sums modulo 2^32 of the halves of two 64-bit hashes. Equal multisets have equal sums, others differ but
  for a chance of about 2^-128; order does not matter.
* ``lanes``: 62 counters modulo 2^30, two to a number, each counting the paragraphs whose hash has that bit. With the
  paragraph count they give 62 sums of random signs, whose normalised dot product estimates how much two multisets share. A
  text would need 2^30 pieces for a counter to wrap, which is more than a column value holds in any text but one of single blanks.

Sums and lanes add: the fingerprint after an insertion or deletion is the old one plus or minus that of the paragraphs.

Defined cases: a null text is the empty text; empty texts are alike (1.0) and unlike any other (0.0); equal texts have
equal fingerprints; repeated rows follow one another in the order (id, text); null ids come first; the document after the
last is the first, a single one follows itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm.common import shuffle_parts, stored, whole_text
from sigloom.operators.ordered import BUCKET, range_bucket

PARAGRAPH_WORDS = 3
LANE_BITS = 31
LANES = 2 * LANE_BITS
ONES = 1 | 1 << LANE_BITS
LANE = (1 << LANE_BITS - 1) - 1
KEEP = LANE * ONES
HALF = 0xFFFFFFFF
MAX_LEVELS = 20


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def paragraphs(text: Column) -> Column:
    """The pieces of a text; together they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?:\S++[^\S\n]*+){{1,{PARAGRAPH_WORDS}}}+\n?+|\s"), F.lit(0))


def hashed(text: Column) -> Column:
    """The two hashes of every piece."""
    return F.transform(paragraphs(text), lambda p: F.struct(F.xxhash64(p).alias("h"), F.xxhash64(p, F.lit(1)).alias("g")))


def summed(hashes: Column) -> Column:
    """Fingerprint of a column that holds the hashes of the pieces."""
    total = lambda get: F.aggregate(hashes, _long(0), lambda a, x: (a + get(x)).bitwiseAND(_long(HALF)))
    sums = F.array(
        total(lambda x: x["h"].bitwiseAND(_long(HALF))), total(lambda x: F.shiftrightunsigned(x["h"], 32)),
        total(lambda x: x["g"].bitwiseAND(_long(HALF))), total(lambda x: F.shiftrightunsigned(x["g"], 32)),
    )
    lane = lambda s: F.aggregate(hashes, _long(0), lambda a, x: (a + F.shiftrightunsigned(x["h"], s).bitwiseAND(_long(ONES))).bitwiseAND(_long(KEEP)))
    return F.struct(F.size(hashes).cast("long").alias("n"), sums.alias("sums"), F.array(*[lane(s) for s in range(LANE_BITS)]).alias("lanes"))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint after adding (or, with ``sign`` -1, removing) the pieces behind ``b``."""
    sums = F.zip_with(a["sums"], b["sums"], lambda x, y: F.pmod(x + sign * y, _long(HALF + 1)))
    # the bit above each lane takes a carry; for a difference it is set first, so none borrows from its neighbour
    guard = _long((LANE + 1) * ONES if sign < 0 else 0)
    lanes = F.zip_with(a["lanes"], b["lanes"], lambda x, y: (x.bitwiseOR(guard) + sign * y).bitwiseAND(_long(KEEP)))
    return F.struct((a["n"] + sign * b["n"]).alias("n"), sums.alias("sums"), lanes.alias("lanes"))


def as_text(f: Column) -> Column:
    """Fixed-width hexadecimal form."""
    numbers = F.transform(F.concat(F.array(f["n"]), f["sums"], f["lanes"]), lambda x: F.lpad(F.lower(F.hex(x)), 16, "0"))
    return F.array_join(numbers, "")


def _signed_dot(a: Column, b: Column) -> Column:
    def both(x: Column, y: Column) -> Column:
        out = F.lit(0.0)
        for k in range(2):
            u, v = (2 * F.shiftrightunsigned(z, k * LANE_BITS).bitwiseAND(_long(LANE)) - f["n"] for z, f in ((x, a), (y, b)))
            out = out + u.cast("double") * v.cast("double")
        return out

    return F.aggregate(F.zip_with(a["lanes"], b["lanes"], both), F.lit(0.0), lambda t, x: t + x)


def likeness(a: Column, b: Column) -> Column:
    """Share of common pieces from 0 to 1, from the fingerprints alone."""
    size = F.sqrt(_signed_dot(a, a) * _signed_dot(b, b))
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _signed_dot(a, b) / size))
    return F.when((a["n"] == b["n"]) & (a["sums"] == b["sums"]), 1.0).when((a["n"] == 0) | (b["n"] == 0) | (size == 0), 0.0).otherwise(near)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    return df.withColumn("_h", hashed(F.col(text))).withColumn(out, summed(F.col("_h"))).drop("_h")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, print`` with ``next_text, next_print`` of the following document.

    Ids are cut into ranges at approximate quantiles; each range is ordered on its own and ends with a copy of the first
    row of the range behind it, so a text is shuffled once and no task holds more than a range.
    """
    parts = shuffle_parts(docs.sparkSession)
    levels = max(4, min(MAX_LEVELS, (2 * parts - 1).bit_length()))
    rows = range_bucket(docs.select("doc_id", whole_text().alias("text")), "doc_id", levels=levels).withColumnRenamed(BUCKET, "_range")
    # one row a range
    least = rows.groupBy("_range").agg(F.min("doc_id").alias("_id"), F.count_if(F.col("doc_id").isNull()).alias("_nulls"))
    order = Window.orderBy("_range")
    before = F.coalesce(F.lag("_range").over(order), F.max("_range").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    least = stored(least.withColumn("_before", before), "ranges").withColumn("_id", F.when(F.col("_nulls") == 0, F.col("_id"))).drop("_nulls")
    mine = rows.alias("r").join(F.broadcast(least).alias("l"), (F.col("r._range") == F.col("l._range")) & F.col("r.doc_id").eqNullSafe(F.col("l._id")))
    firsts = mine.groupBy("_before").agg(F.min("r.text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("_before").alias("_range"), F.lit(True).alias("_copy"))
    both = with_fingerprint(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_range", F.lit(False).alias("_copy")).unionByName(firsts), "text", "print")
    ahead = Window.partitionBy("_range").orderBy("_copy", "doc_id", "text")
    return both.withColumns({"next_text": F.lead("text").over(ahead), "next_print": F.lead("print").over(ahead)}).filter(~F.col("_copy")).drop("_copy", "_range")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Per row: fingerprints of the text and of its edited form (last quarter replaced by the start of the next document)."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.substr("next_text", F.lit(1), quarter))
    rows = with_fingerprint(rows.withColumn("edited", edited), "edited", "edited_print")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"), likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
