"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standtally.sources.staging import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it knows, itself included."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (
        down.join(least, "u")
        .select(F.inline(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))))
        .toDF("u", "v")
    )


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (u, v); the root is the smallest node reached.

    Each round is written to the shared folder, and only its number of edges and a checksum
    come to the driver. Minima are combined before the shuffle, so that a node with very
    many edges costs its tasks no more than the edges they hold.
    """
    current = stage(_tidy(edges.select("u", "v")), "edges")
    seen = None
    while True:
        current = stage(_tidy(_small_star(_tidy(_large_star(current)))), "edges")
        state = current.agg(
            F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20)))
        ).first()
        if state == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("root"))
            ).distinct()
        seen = state
