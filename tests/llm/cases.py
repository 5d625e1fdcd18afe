"""Small tables with the awkward rows that every operator must define."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, block int, rank long"
WORDS = "the of river stone light and under water house green over night wind paper small old far wide".split()


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        w = rnd.choice(WORDS) + rnd.choice(["", "", "s", "ed", "ing"])
        out.append((w.capitalize() if i % 9 == 0 else w) + ("." if i % 9 == 8 else "") + ("\n" if i % 45 == 44 else " "))
    return "".join(out).strip()


def awkward_rows() -> list[tuple]:
    base = prose(7, 160)
    near = base.replace("river", "rivers", 1)
    texts = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, "one two"), (7, "one two"), (8, prose(8, 3000)), (9, "x" * 30_000), (10, " \n\t \n"),
        (11, "Señor Ünal, 日本語 é <|endoftext|> <|im_end|> don't!"), (12, base), (12, base), (13, "mail a.b@mail.example.org or +1 (202) 555-0143, 10.0.0.7, 4111 1111 1111 1111"),
        (None, prose(9, 40)), (14, prose(10, 60) + "\n" + prose(11, 60)), (15, "A!! B!! C!! D!!\n" * 9),
    ]
    return [(d, t, "en", "src0", len(t or ""), 0.5, "k", 1, 2) for d, t in texts]


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
