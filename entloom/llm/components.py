"""Connected components of a table of links, by alternating stars.

Each round every node points its larger neighbours (large star), then its smaller ones
(small star), to the smallest node it knows. Rounds grow with the logarithm of the longest path. Each round is
written to the shared folder, so the plan stays short and executors may be lost; nothing but one
number a round reaches the driver. A hot node is no hot task: the least neighbour is a partial sum, and joins on it are AQE's to split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entloom.llm.common import released, stored


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) with v < u, each node u to its component's least known node: pairs both ways in, links out."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node of its component) for every node of a link between two different nodes."""
    links = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = stored(links, "links")
    before = None
    while True:
        old_links = links
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: neighbours above u go to the least of u and its neighbours.
        large = _star(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # Small star: u and its smaller neighbours go to the least of them.
        small = _star(large)
        links = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        links = stored(links, "links")
        released(old_links)
        now = links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
