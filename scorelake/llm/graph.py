"""Connected components of a link table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, functions as F

from scorelake.session import freed, materialise

cut = partial(materialise, free=True)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `links` (a long, b long); root is the smallest node reachable.

    Large-star and small-star steps in turn: each node's larger neighbours, then its smaller ones,
    move to the smallest neighbour. Every step is one aggregate before a shuffle and one join, which
    AQE splits at a hot node. Rounds end when no link changes; their number grows with the logarithm
    of the longest path. Each round is checkpointed, and its shuffle files go with it: a round writes little,
    but a file for each of its tasks. Null nodes are left out.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges)
    state = _digest(edges)
    for _ in range(max_rounds):
        edges = cut(_small_star(_large_star(edges)))
        now = _digest(edges)
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
        state = now
    raise RuntimeError(f"components not found in {max_rounds} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    moved = edges.join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("w"), "m").toDF("u", "v")).distinct()


def _digest(edges: DataFrame) -> tuple:
    with freed(edges.sparkSession):
        row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
    return tuple(row)
