"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every larger end a hangs on one smaller end b, which hangs on none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1)))).first()[0] == 0


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b), both bigint: root is the component's smallest node.

    Each round hangs a node's larger neighbours, then its smaller ones, onto its smallest neighbour; the number of rounds
    grows as the logarithm of the component's size. Edges meet only with the minimum of their own node, so a hub is joined
    in parts and never gathered. No edges give no nodes; loops and repeated edges change nothing.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc-edges")
    for _ in range(rounds):
        if is_forest_of_stars(now):
            break
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "cc-large")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(least, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x")).select("x.a", F.col("x.m").alias("b")).where("a <> b").distinct()
        now = materialize(small, "cc-small")
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
