"""Connected components by alternating large-star and small-star.

Both steps keep the components and move every edge towards the smallest node. A step reads a
node's neighbours only through a minimum, so a node with very many neighbours is combined before
the shuffle; no neighbour list is ever built. The edges are written after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from poolsight.session import cut

MAX_ROUNDS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; `u` is above `v` in every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(xxhash64(u, v) % 1000003)")).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (two long columns): root is the component's smallest node.

    Nulls, loops and repeated edges are ignored; an empty table gives an empty result.
    """
    first, second = edges.columns[:2]
    pairs = edges.select(F.col(first).cast("long").alias("u"), F.col(second).cast("long").alias("v")).dropna()
    stored = cut(_ordered(pairs))
    mark = _mark(stored)
    for _ in range(MAX_ROUNDS):
        stored = cut(_ordered(_small_star(_ordered(_large_star(stored)))))
        after = _mark(stored)
        if after == mark:
            roots = stored.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
            return stored.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        mark = after
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
