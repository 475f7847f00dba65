"""Connected components of a graph in Spark: alternating large-star and small-star rounds on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import drop_scratch, scratch


def _state(edges: DataFrame) -> tuple:
    """What tells whether a round changed anything: one row."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))).first())


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links (a, b: long) -> node, root: every node that has a link to another one, with the least node it reaches.

    A round takes each node's larger neighbours to its least neighbour, then each node and its smaller
    neighbours to the least of them; the number of rounds is logarithmic in practice. Minima are written before
    they are joined back, so that a join's both sides are plain shuffles which Spark splits where a node is hot.
    """
    edges = scratch(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", narrow=True
    )
    state = _state(edges)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = scratch(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "large", narrow=True)
        large = both.filter("v > u").join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch(large, "star", narrow=True)
        least = scratch(large.groupBy("u").agg(F.min("v").alias("m")), "small", narrow=True)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        past, edges = edges, scratch(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges", narrow=True)
        before, state = state, _state(edges)
        drop_scratch(past, nearest, large, least)  # the round's result is written
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
