"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), in DataFrame functions.

Every step is a partial aggregate (the smallest neighbour of a node) and an equi-join, so a node with very many neighbours
neither meets in one group nor is collected; adaptive execution may split its side of the join. Each round is written to
the shared folder. Links with a null end and links of a node to itself are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm._common import scratch, stage


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.shiftright(F.xxhash64("v", "u"), 20)).alias("s")).first()
    return tuple(row)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node of its component. The result is a staged table."""
    with scratch(links.sparkSession):
        ends = links.where(F.col(a) != F.col(b))
        edges = stage(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc-links")
        seen = _signature(edges)
        while seen[0]:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where(F.col("v") > F.col("u")).join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large = stage(large, "cc-large")
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
            now = _signature(edges)
            if now == seen:
                break
            seen = now
        roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
        return stage(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "cc-roots", outlive=True)
