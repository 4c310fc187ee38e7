"""Connected components by alternating large-star and small-star steps.

Kiveris et al., Connected Components in MapReduce and Beyond, 2014. A step is
an aggregation (combined map-side) and a join with a table that has one row
for each node, written first so that AQE can split a hot centre's rows. Every
step's edges are written to shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import done, written


def _least(edges: DataFrame, tag: str) -> DataFrame:
    return written(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), tag)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, "least")
    near = both.join(least, "u")
    out = written(near.filter("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
    done(least, edges)
    return out


def _small(edges: DataFrame) -> DataFrame:
    least = _least(edges, "least")
    near = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = written(near.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    done(least, edges)
    return out


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour and no larger one, or larger ones only: the roots are found."""
    up, down = F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ends = edges.select(F.explode(F.array(up, down)).alias("x")).groupBy("x.node").agg(F.sum("x.up").alias("up"), F.max("x.down").alias("down"))
    return ends.filter("up > 1 or up = 1 and down = 1").agg(F.count(F.lit(1))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (bigints u, v): the smallest node that it reaches.

    The roots themselves are rows too. Loops are ignored; nodes without links
    are not in the result. Rounds are logarithmic in practice and never cut off.
    """
    edges = written(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _stars(edges):
        edges = _small(_large(edges))
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionAll(pairs.select(F.col("root").alias("node"), "root").distinct())
