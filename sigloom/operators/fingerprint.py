"""Content fingerprints, duplicate links and independence groups.

Groups of copies are linked as stars (every member to the smallest id), never as all pairs, so a group
that holds a third of all rows still yields one edge per member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.operators import ordered
from sigloom.session import checkpointed

MIN_SHARED_BLOCKS = 2
MAX_ROUNDS = 60


def representatives(df: DataFrame, key: str, node: str) -> DataFrame:
    """Smallest node and size per key; partial aggregation absorbs hot keys."""
    return df.groupBy(key).agg(F.min(node).alias("rep"), F.count(F.lit(1)).alias("size"))


def identical_links(df: DataFrame, key: str, node: str) -> DataFrame:
    """Star edges (a, b) from the smallest node of each key to the others."""
    reps = representatives(df, key, node).filter("size > 1")
    return df.join(reps, key).filter(F.col("rep") != F.col(node)).select(F.col("rep").alias("a"), F.col(node).alias("b"))


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the smallest ``order``."""
    cols = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("_r"), F.count(F.lit(1)).alias("n_copies"))
    return first.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols], "n_copies")


def overlap_links(blocks: DataFrame, node: str, block: str) -> DataFrame:
    """Edges whose components are those of "shares at least two blocks", by one rule for every block.

    ``blocks`` holds distinct (node, block) rows of nodes with different content. Blocks with one owner go; blocks with
    the same owners become one kind. A kind of two or more blocks links its owners as a star at once (this takes the
    boilerplate). Otherwise two nodes share two kinds, so they meet under a pair of kinds: nodes with the same kinds form
    a star, and one node per distinct set is linked through its pairs, again as stars. A frequent block never pairs nodes.
    """
    blocks = blocks.select(F.col(node).alias("_nd"), F.col(block).alias("_bk"))
    owners = blocks.groupBy("_bk").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_nd").alias("_rep"), F.bit_xor(F.xxhash64("_nd")).alias("_x"), F.sum(F.hash("_nd").cast("long")).alias("_s")
    ).filter("_n > 1")
    same = ["_n", "_rep", "_x", "_s"]
    kinds = owners.join(owners.groupBy(*same).agg(F.min("_bk").alias("_kind"), F.count(F.lit(1)).alias("_size")), same)
    owned = checkpointed(blocks.join(kinds.select("_bk", "_kind", "_rep", "_size"), "_bk").select("_nd", "_kind", "_rep", "_size").distinct())
    twins = owned.filter(F.col("_size") >= MIN_SHARED_BLOCKS).filter("_nd <> _rep").select(F.col("_rep").alias("a"), F.col("_nd").alias("b"))
    # at most one entry per line of a text
    many = owned.groupBy("_nd").agg(F.array_sort(F.collect_set("_kind")).alias("_kinds")).filter(F.size("_kinds") >= MIN_SHARED_BLOCKS)
    many = many.withColumn("_set", F.sha1(F.array_join("_kinds", "|")))
    first = many.groupBy("_set").agg(F.min("_nd").alias("_nd"), F.any_value("_kinds").alias("_kinds"))
    first = first.select("_nd", "_kinds", F.posexplode("_kinds").alias("_i", "_one"))
    pairs = first.select("_nd", "_one", F.explode(F.slice("_kinds", F.col("_i") + 2, F.size("_kinds"))).alias("_two"))
    pairs = pairs.select("_nd", F.concat_ws("|", "_one", "_two").alias("_k"))
    return twins.union(identical_links(many.select("_nd", "_set"), "_set", "_nd")).union(identical_links(pairs, "_k", "_nd")).distinct()


def connected_components(nodes: DataFrame, edges: DataFrame, node: str, root: str = "root") -> DataFrame:
    """Smallest reachable node of every node, by alternating star contractions.

    Each round is two aggregations and joins on the edge table; the lineage is cut every round. Hub nodes
    are spread by the adaptive skew join because the joined minimum has one row per node.
    """
    def symmetric(e: DataFrame) -> DataFrame:
        return e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")

    def contract(e: DataFrame, large: bool) -> DataFrame:
        near = symmetric(e) if large else e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = near.join(low, "u")
        if large:
            linked = joined.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            linked = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).union(low.select(F.col("m"), F.col("u")))
        return linked.filter("a <> b").distinct()

    current = checkpointed(edges.select("a", "b").filter("a <> b").distinct())
    seen: object = None
    for _ in range(MAX_ROUNDS):
        current = checkpointed(contract(contract(current, True), False))
        stamp = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if stamp == seen:
            break
        seen = stamp
    else:
        raise RuntimeError("components did not settle")
    parent = current.groupBy(F.col("b").alias(node)).agg(F.min("a").alias("_r"))
    return nodes.select(node).distinct().join(parent, node, "left").select(node, F.coalesce("_r", node).alias(root))


def dense_groups(components: DataFrame, node: str, root: str = "root") -> DataFrame:
    """Component number in root order, from 0, and component size."""
    sizes = components.groupBy(root).agg(F.count(F.lit(1)).alias("group_size"))
    codes = ordered.scan(ordered.range_bucket(sizes, root), [], [root], position="_pos")
    codes = codes.select(root, (F.col("_pos") - 1).alias("split_group"), "group_size")
    return components.join(codes, root).select(node, "split_group", "group_size")


def mixed_groups(df: DataFrame, group: str, flag: Column) -> DataFrame:
    """Groups holding both held-out and training members; a valid assignment has none."""
    return df.groupBy(group).agg(F.bool_or(flag).alias("_any"), F.bool_and(flag).alias("_all")).filter("_any AND NOT _all").select(group)


def resolve_ambiguous(df: DataFrame, subject: str, order: str, content: str, is_rest: Column) -> DataFrame:
    """Within-subject policy for copies: adds ``usable`` and ``reason``.

    A rest record with the content of some task is dropped together with those tasks; a task with the content
    of an earlier kept task is dropped. Rows with NULL content are unreadable and left alone.
    """
    rows = df.withColumn("_rest", is_rest)
    rest = rows.filter("_rest").groupBy(subject).agg(F.min_by(content, order).alias("_rh"))
    tasks = rows.filter(~F.col("_rest") & F.col(content).isNotNull())
    first = tasks.groupBy(subject, content).agg(F.min(order).alias("_first"))
    rows = rows.join(rest, subject, "left").join(first, [subject, content], "left")
    twin = F.col("_rh") == F.col(content)
    reason = (
        F.when(F.col("_rest") & F.col("_first").isNotNull(), "same content as a task")
        .when(~F.col("_rest") & twin, "same content as rest")
        .when(~F.col("_rest") & (F.col("_first") < F.col(order)), "duplicate of an earlier task")
    )
    out = rows.withColumn("reason", F.coalesce(reason, F.lit("ok"))).withColumn("usable", F.col("reason") == "ok")
    return out.drop("_rest", "_rh", "_first")


def text_blocks(text: Column, min_chars: int) -> Column:
    """Distinct fingerprints of the informative lines of a text."""
    lines = F.filter(F.split(text, "\n"), lambda s: F.length(s) >= min_chars)
    return F.array_distinct(F.transform(lines, lambda s: F.sha1(s)))

