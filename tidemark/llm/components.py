"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage


def _least(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour, itself included; pre-aggregated, so a hub ships one row per task."""
    return edges.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", name: str = "components") -> DataFrame:
    """(node, component) of every node of the undirected edge table; the component is its least node.

    Each round links nodes to the least of their neighbours by joins on the node (AQE splits hubs); rounds are about
    the logarithm of the longest path. Self loops keep single nodes; null ends are dropped. Every round is a table in
    the shared checkpoint folder, so a lost executor costs one round at most.
    """
    given = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = given.select("u").union(given.select("v")).distinct()
    now = stage(given.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                f"{name}-edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        small = large.join(_least(large), "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = stage(small, f"{name}-round")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
    return (nodes.join(now.select("u", F.col("v").alias("m")), "u", "left")
            .select(F.col("u").alias("node"), F.coalesce("m", "u").alias("component")))
