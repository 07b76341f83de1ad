"""Connected components of links between documents, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlore.session import materialize


def join_split(rows: DataFrame, other: DataFrame, key: str, *more: str) -> DataFrame:
    """Inner join on ``key``, a long, and ``more``, where ``other`` is an aggregate by these columns.

    Joined on the aggregate's own partitioning, a hot key of ``rows`` would stay whole in one task. A key that only
    looks different gives both sides an exchange of their own, which adaptive execution may split.
    """
    mark = lambda df: df.withColumn("__key", F.bitwise_not(key)).drop(key)
    joined = mark(rows).join(mark(other), ["__key", *more])
    return joined.withColumn(key, F.bitwise_not("__key")).drop("__key")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (``node``, ``component``, ``peers``) after links (``u``, ``v``) between nodes have joined components.

    A component goes to the neighbour with most links, if that has more than it, and from there up to four steps on.
    Only linked components are joined, but of those with a long way between them some may stay apart: this is a
    cheap step in between, where ``components`` gives the whole answer. ``peers`` counts a component's nodes.
    """
    side = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    ends = links.join(side("u"), "u").join(side("v"), "v").where("cu <> cv").select("cu", "cv").distinct()
    both = materialize(ends.union(ends.select("cv", "cu")).distinct())
    degree = both.groupBy("cu").agg(F.count("*").alias("n"))
    ranked = both.join(degree.select(F.col("cu").alias("cv"), F.col("n").alias("m")), "cv")
    up = ranked.groupBy("cu").agg(F.max(F.struct("m", "cv")).alias("top"), F.count("*").alias("n"))
    up = up.where(F.col("top") > F.struct("n", "cu")).select(F.col("cu").alias("a"), F.col("top.cv").alias("b"))
    for _ in range(2):  # twice as far each time
        further = up.select(F.col("a").alias("b"), F.col("b").alias("c"))
        up = materialize(up.join(further, "b", "left").select("a", F.coalesce("c", "b").alias("b")))
    moved = labels.join(up.withColumnRenamed("a", "component"), "component", "left").select(
        "node", F.coalesce("b", "component").alias("component"))
    peers = moved.groupBy("component").agg(F.count("*").alias("peers"))
    return materialize(join_split(moved, peers, "component"))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for every node of ``links`` (``u``, ``v``).

    Large-star and small-star steps in turn, until every node points at the smallest of its component; the
    number of rounds grows with the logarithm of the longest path. A node with very many neighbours is only
    ever a join key, which adaptive execution splits, and never a group in one task. Each round is a written
    table. No links give no rows.
    """
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # Large star: larger neighbours of a node link to the smallest neighbour.
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = join_split(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = materialize(large.where("u <> v").distinct())
        # Small star: smaller neighbours and the node itself link to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = join_split(large, low, "u")
        moved = small.select(F.col("v").alias("u"), F.col("low").alias("v")).union(small.select("u", F.col("low").alias("v")))
        following = materialize(moved.where("u <> v").distinct())
        # Done when all edges lead from a node straight to one that leads nowhere.
        twice = following.groupBy("u").count().where("count > 1")
        if following.join(following.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and twice.isEmpty():
            break
        edges = following
    roots = following.select(F.col("v").alias("node")).distinct()
    return (following.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(roots.select("node", F.col("node").alias("component"))))
