"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from introna.llm.common import stored


def _are_stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one edge and no ``v`` is a ``u``; as ``u`` > ``v``, each star's centre is then its smallest node."""
    ends = F.explode(F.array(
        F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("low")),
    ))
    nodes = edges.select(ends.alias("e")).groupBy("e.x").agg(F.sum("e.up").alias("up"), F.max("e.low").alias("low"))
    return nodes.where("up > 1 or (up > 0 and low > 0)").count() == 0


SALTS = 8  # parts that the rows of one node are dealt over where they meet its minimum


def _with_minimum(rows: DataFrame, minima: DataFrame) -> DataFrame:
    """Rows ``u, v`` with ``m`` of ``u``; a node with very many rows is spread over the salts."""
    salted = minima.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["u", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges ``u, v``; the component is its smallest node.

    Large-star ties every larger neighbour of a node to the smallest node around it, small-star every
    smaller neighbour; the edges end as stars around the smallest nodes. Minima are combined before the
    shuffle, so a node with very many neighbours costs one row per task. Self-loops, repeated edges and
    null ends are dropped; no edges give no rows. Every round is written to the shared folder.
    """
    a, b = F.col("u").cast("long"), F.col("v").cast("long")
    edges = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _with_minimum(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # repeated edges change no minimum; they go at the end of the round
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_minimum(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    root = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(root)
