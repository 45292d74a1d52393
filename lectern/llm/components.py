"""Connected components of a table of links, by large-star and small-star rounds on DataFrames."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written

#: Rounds after which something must be wrong: each round at least halves the depth in practice.
MOST_ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of a link, the smallest node reachable from it.

    Every round turns each node's neighbourhood into a star around its smallest member: first for larger neighbours, then
    for smaller ones. Links only ever join nodes of one component, so rounds end when nothing changes. A node's
    neighbours are aggregated, never collected. Each round is a written table in the shared folder."""
    edges = written(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct(), "links")
    mark = None
    for _ in range(MOST_ROUNDS):
        # Large star: each node links its larger neighbours to the smallest of its neighbourhood.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # Small star: each node links its smaller neighbours, and itself, to the smallest of them.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a < b")
        edges = written(small.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == mark:
            return edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component")).union(edges.select("u", "u").distinct())
        mark = now
    raise RuntimeError("components did not settle")
