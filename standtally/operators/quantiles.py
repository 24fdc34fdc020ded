"""Exact quantiles of very long groups by counting, not by collecting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Buckets per factor of e in magnitude; bounds the bucket count whatever the data size.
BUCKETS_PER_E = 4096


def magnitude_bucket(v: Column) -> Column:
    """A whole number that never decreases with the value."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * BUCKETS_PER_E).cast("bigint")


def value_counts(df: DataFrame, group: str, value: str) -> DataFrame:
    """Distinct values per group with their number of rows; missing values leave."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(group, value)
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def exact_quantiles(
    counts: DataFrame, group: str, value: str, probs: Sequence[float]
) -> DataFrame:
    """Linear-interpolated quantiles per group as columns ``q0``, ``q1``, ... plus ``n``.

    ``counts`` comes from ``value_counts`` (stage it: it is read twice). Bucket counts,
    bounded in number, locate the buckets that hold the wanted ranks; only the distinct
    values in those buckets are then ordered. No group's values ever meet in one task.
    """
    counted = counts.select(
        group,
        F.col(value).alias("_v"),
        F.col("n_rows").alias("_c"),
        magnitude_bucket(F.col(value)).alias("_b"),
    )
    running = W.partitionBy(group).orderBy("_b")
    buckets = (
        counted.groupBy(group, "_b")
        .agg(F.sum("_c").alias("_bc"))
        .withColumn("_b_end", F.sum("_bc").over(running))
        .withColumn("_n", F.sum("_bc").over(W.partitionBy(group)))
        .withColumn("_b_start", F.col("_b_end") - F.col("_bc"))
    )
    positions = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    wanted = [f(p) for p in positions for f in (F.floor, F.ceil)]
    holds = F.lit(False)
    for rank in wanted:
        holds = holds | ((rank >= F.col("_b_start")) & (rank < F.col("_b_end")))
    # At most two buckets per probability and group survive this filter.
    hits = buckets.filter(holds).select(group, "_b", "_b_start", "_n")
    inside = W.partitionBy(group, "_b").orderBy("_v")
    ordered = (
        counted.join(hits, [group, "_b"])
        .withColumn("_end", F.col("_b_start") + F.sum("_c").over(inside))
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )

    def at(rank: Column) -> Column:
        inside_run = (rank >= F.col("_start")) & (rank < F.col("_end"))
        return F.max(F.when(inside_run, F.col("_v")))

    picks = []
    for i, position in enumerate(positions):
        picks.append(at(F.floor(position)).alias(f"_lo{i}"))
        picks.append(at(F.ceil(position)).alias(f"_hi{i}"))
    out = ordered.groupBy(group, "_n").agg(*picks)

    def between(i: int, p: float) -> Column:
        place = (F.col("_n") - 1) * F.lit(float(p))
        share = place - F.floor(place)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        return (lo + (hi - lo) * share).alias(f"q{i}")

    return out.select(
        group, F.col("_n").alias("n"), *[between(i, p) for i, p in enumerate(probs)]
    )
