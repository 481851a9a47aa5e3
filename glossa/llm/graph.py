"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long) but the roots; the root is the least node.

    Each round is two aggregations that combine before the shuffle and two equi-joins (hubs are split by
    adaptive skew joins); the rounds grow with the logarithm of the longest chain. Null ends and loops
    are ignored; no edges give no rows.
    """
    now = (
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        state = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
    raise RuntimeError(f"no end after {max_rounds} rounds")
