"""Connected components by alternating stars, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelag.llm.common import drop_staged, stage


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of links (a, b); self-links count.

    Each round points every neighbour of a node at the smallest it knows, first the larger neighbours,
    then the smaller ones; the number of rounds grows with the logarithm of a component's length. Every
    round is written and read again. Rows with a null end are left out.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL")
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.union(small.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        after = stage(star.union(edges.where("u = v")).distinct(), "edges")
        drop_staged(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    ends = edges.where("u > v").select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = edges.select(F.col("v").alias("node")).distinct().join(ends, "node", "left_anti")
    return ends.union(heads.select("node", F.col("node").alias("component")))
