"""Connected components of a link table, by alternating star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estima.llm.common import join_unique, written

#: Links that one task could hold whatever their keys: below, plain joins.
NARROW = 200_000


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """Rows (node, component) of every node of a link; component: its smallest reachable node.

    Each round links a node's larger neighbours to its smallest one, then its smaller
    neighbours likewise, until the links are stars; the number of rounds grows with the logarithm
    of a component's size. A round is grouped minima and joins that stay even when one node has
    most of the links. Rounds are written to the shared folder; the driver sees two numbers.
    """
    a, b = F.col(left), F.col(right)
    edges = written(links.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links")
    total, stars = _state(edges)
    while not stars:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = (join_unique(both, least, "u", 2 * total, "n", NARROW).where("v > u")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct())
        large = written(large, "links")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        small = (join_unique(large, least, "hi", large.count(), "n", NARROW).where("lo != m")
                 .select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo"))))
        edges = written(small.where("hi != lo").distinct(), "links")
        total, stars = _state(edges)
    tops = edges.select(F.col("lo").alias("node")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        tops.select("node", F.col("node").alias("component")))


def _state(edges: DataFrame) -> tuple[int, bool]:
    """Number of links, and whether every node is either the centre of a star or the end of one link."""
    nodes = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    per = nodes.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    r = per.agg(F.sum("up").alias("links"), F.count_if(F.col("up") + F.col("down") > 1).alias("open")).first()
    return r["links"] or 0, not r["open"]
