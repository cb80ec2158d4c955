"""Connected components of an edge table, by rounds of hooking onto the smallest neighbour and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendspan.session import drop, written


def _state(edges: DataFrame) -> tuple:
    """What tells one set of edges from another, without regard to their order."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    Each round links every node's neighbours to the smallest of them and the node itself (large-star, then
    small-star): the edges stay about as many, hot nodes are summed up before the shuffle, and the rounds are about
    the logarithm of the longest path. Ends when no edge changes, which an order-free checksum of the edges tells.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    state = _state(now)
    for _ in range(most_rounds if state[0] else 0):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("x"), F.col("b").alias("y"), "a")
        small = small.select("x", F.explode(F.array("y", "a")).alias("y")).filter("x <> y").distinct().select(F.col("x").alias("a"), F.col("y").alias("b"))
        old, before = now, state
        now = written(small)
        state = _state(now)
        drop(old)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    tree = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return tree.union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
