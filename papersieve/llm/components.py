"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` for each node of ``edges`` (``a``, ``b``); a component is its least node.

    Alternates two steps until every edge leads to the least node of its component:
    every node hands its larger neighbours, then its smaller ones, to the least of
    its neighbourhood. Each round is a stored table and about halves the distances;
    no node's neighbours are ever collected. An empty graph has no rows.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while True:
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
            now.select("v", F.lit(0), F.lit(1))
        )
        degrees = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        # edges lead downwards: it is done once each node has one edge up or any number from above
        if not degrees.where("up + down > 1").limit(1).count():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_least_neighbour(both), "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
            .distinct()
        )
        least = _least_neighbour(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v")
        now = stored(small.distinct())


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``found`` after further ``links`` (``a``, ``b``), whose nodes may be new; as ``components``.

    Only the links are searched again, each between two components.
    """
    held = found.select(F.col("node").alias("a"), F.col("component").alias("held"))
    low = links.join(held, "a", "left").select(F.coalesce("held", "a").alias("low"), F.col("b").alias("a"))
    edges = low.join(held, "a", "left").select(F.col("low").alias("a"), F.coalesce("held", "a").alias("b"))
    above = stored(components(edges)).withColumnRenamed("component", "least")
    new = above.join(found, "node", "left_anti").select("node", F.col("least").alias("component"))
    moved = found.join(above.withColumnRenamed("node", "component"), "component", "left")
    return moved.select("node", F.coalesce("least", "component").alias("component")).unionAll(new)
