"""Connected components of a table of links, by alternating large and small stars.

Every round points each node's larger neighbours (large star) and then its smaller ones (small star) at the smallest node around
it. The number of links never grows, a node with very many links is handled by joins and partial minima only, and the rounds
needed are logarithmic. Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import written


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node point at the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "node")
    return both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, point at the smallest of them. Links run from u down to v."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "node")
    moved = links.join(least, F.col("u") == F.col("node")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node that has a link to another one; ``root`` is the smallest node of its component.

    ``links`` has columns u and v of one orderable type; direction, repeats and self-links do not matter. A link with a null end is none; no
    links give no rows; further columns are ignored.
    """
    now = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct(), "stars")
    seen = _state(now)
    while seen[0]:
        now = written(_small_star(written(_large_star(now), "stars")), "stars")
        state = _state(now)
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
