"""Connected components by alternating large-star and small-star.

Edges are rows (hi, lo) with hi > lo. Both steps only need a node's smallest
neighbour, so they are a partial-aggregated minimum and an equi-join back (AQE
splits a hub's rows); no node's neighbours are gathered. Each pass is written
to the shared checkpoint folder. At the fixed point every edge points from a
node to the smallest id of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transitlake.llm.common import cut, rejoin


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (rejoin(both.filter("v > u"), least, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = rejoin(edges, least, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return least.select("hi", F.col("m").alias("lo")).unionByName(moved).distinct()


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """(v, comp) of every node that is not the smallest of its component."""
    edges = cut(edges.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo"))
                .filter("hi > lo").distinct())
    mark = _mark(edges)
    while mark[0]:
        edges = cut(_small_star(_large_star(edges)))
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    return edges.select(F.col("hi").alias("v"), F.col("lo").alias("comp"))
