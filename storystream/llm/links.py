"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storystream.session import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, label: str) -> DataFrame:
    """Rows (node, root) for every node of `edges` (a, b) but the roots, which are the smallest of their component.

    Alternating large-star and small-star steps (Kiveris et al. 2014); every
    step is a minimum per node and a join, the edges of a step are written to
    the shared folder, and only their count and checksum reach the driver.
    Edges with a null end and loops are ignored; no edges give no rows.
    """
    stars = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct()
    before = None
    while True:
        stars = materialize(_small_star(_large_star(stars)).where("u <> v").distinct(), label)
        state = stars.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before or not state[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
