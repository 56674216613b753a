"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waypost.llm.shared import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    around = _both(edges)
    least = stored(around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
    return around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = stored(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    tied = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of ``links`` (a, b) but the roots, the smallest node reachable.

    ``links`` are undirected pairs of longs; repeats and self links do no harm,
    and an empty table gives an empty one. Roots of components aren't listed.
    Every round is written to the shared folder, so lineage stays short, and so
    is what edges are joined to, so that Spark may split the join where a node
    has many edges; the only things that reach the driver are a row count and a
    checksum.
    """
    edges = stored(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b"), "edges")
    before = None
    while True:
        now = edges.agg(
            F.count("*"), F.sum(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).cast("decimal(38,0)"))
        ).first()
        if now == before or not now[0]:
            return edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
        before = now
        edges = stored(_small_star(_large_star(edges)).filter("a <> b").distinct(), "edges")
