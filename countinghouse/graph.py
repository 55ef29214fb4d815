"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of links (a, b) the smallest node that it reaches.

    Large and small stars by turns (each node hands its neighbours to the
    smallest of them) until nothing changes: about log(n) rounds, a row a link
    in each, and no node's links meet in one task but through splittable joins.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(_to_least(both, least))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        new = cut(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        changed = new.join(edges, ["u", "v"], "left_anti").limit(1).count() or new.count() != edges.count()
        edges = new
        if not changed:
            break
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    own = edges.select(F.col("v").alias("node")).distinct().join(roots.select("node"), "node", "left_anti")
    return roots.unionByName(own.select("node", F.col("node").alias("root")))


def _to_least(both: DataFrame, least: DataFrame) -> DataFrame:
    return least.select("u", F.col("m").alias("v")).where("u != v")
