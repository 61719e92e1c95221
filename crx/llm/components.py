"""Connected components of an edge table, by alternating large and small stars.

Each round maps every node's neighbours to the smallest of them, first the larger
neighbours, then the smaller ones; it ends when no edge changes. A node of very
many neighbours is never gathered: the smallest neighbour is an aggregate, joined
back to the edges (a skewed key is split by the join). Rounds are written to the
shared folder, so lineage stays one round long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crx.llm.common import shared_table


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Written and read back: so both sides of the joins that follow are plain
    exchanges, and the edges of a node with very many can be split."""
    return shared_table(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbour(down)
    joined = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v), root the smallest node of its
    component. Self loops count as nodes; repeated edges and either direction are
    fine; no edges give no rows."""
    edges = shared_table(edges.select("u", "v").distinct(), "edges")
    links = edges.filter("u != v")
    digest = None
    while True:
        links = shared_table(_small_star(_large_star(links)), "stars")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if digest == tuple(now):
            break
        digest = tuple(now)
    alone = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return (alone.join(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
            .select("node", F.coalesce("root", "node").alias("root")))
