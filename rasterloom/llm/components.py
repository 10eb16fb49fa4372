"""Connected components of a graph whose edges don't fit in one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import written

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a long, b long); root is its component's least node.

    Alternating star contraction: every node hands its neighbours above it to its least
    neighbour (large star), then those below it (small star), until each component is
    a star. The edges are written to the shared folder after each round; no round makes
    more edges than there were, so a hub costs no more than its own edges. Self-loops and
    repeated edges don't matter; without edges there are no rows. Nulls aren't allowed.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = written(e, "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select("u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
        e = written(small.where("u <> v").distinct(), "edges")
        # A star has one edge for each node but the root: then no node is both above and below.
        state = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
