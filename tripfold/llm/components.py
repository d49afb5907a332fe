"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripfold.llm.common import stored


def _sum(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for every node of the links (a, b).

    Each step replaces links so that they point to smaller nodes, until only stars round the smallest
    node of each component are left; the number of steps grows with the logarithm of a component's
    size. Every step is a min per node (combined before the shuffle) joined back to its links; it is
    stored, so lineage doesn't grow. No link, an empty table: no rows.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = _sum(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(down, "a")
        small = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(
            down.select("a", F.col("m").alias("b"))
        )
        edges = stored(small.distinct())
        now = _sum(edges)
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
