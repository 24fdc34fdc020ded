"""Comparison of the biomass estimates of the third census."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standtally.functions.semantics import units
from standtally.operators.quantiles import exact_quantiles, value_counts
from standtally.sources.staging import stage

METHODS = ["agb_tree_kg", "agb2_tree_kg", "agb3_tree_kg"]


def agb_methods_long(trees: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """One row per tree and estimate; missing estimates leave."""
    keep = ids if ids is not None else [c for c in trees.columns if c not in METHODS]
    return trees.unpivot(keep, METHODS, "agb_type", "agb_value").filter(
        F.col("agb_value").isNotNull()
    )


def agb_method_boxstats(trees: DataFrame) -> DataFrame:
    """Box-plot statistics per estimate: quartiles, 1.5 IQR whiskers, outliers.

    Trees are read once, into a staged table of distinct values with their counts.
    """
    counts = stage(
        value_counts(agb_methods_long(trees, ids=[]), "agb_type", "agb_value"), "agb-counts"
    )
    boxes = exact_quantiles(counts, "agb_type", "agb_value", [0.25, 0.5, 0.75]).select(
        "agb_type",
        "n",
        F.col("q0").alias("q1"),
        F.col("q1").alias("median"),
        F.col("q2").alias("q3"),
    )
    # One row per estimate, at most three.
    fenced = counts.join(F.broadcast(boxes), "agb_type")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("agb_value") >= F.col("q1") - reach) & (
        F.col("agb_value") <= F.col("q3") + reach
    )
    return fenced.groupBy("agb_type", "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("agb_value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("agb_value"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n_rows"))).alias("outliers"),
    )


# Whole units whose products a sum of 38 digits still holds.
FIT_UNITS = "decimal(19,0)"


def agb_method_fit(trees: DataFrame) -> DataFrame:
    """Straight-line fits of the second and third estimate on the first, in one scan.

    The moments are sums of whole numbers, so the fit is the same to the last bit however
    rows are dealt over tasks. The first estimate keeps 2 decimals and the others 6; a value
    beyond 19 digits of these is missing. With no spread in the first estimate there is no
    line; with none in the other one it fits fully.
    """

    def fit(y: str) -> Column:
        pair = F.col(f"{y}_n")
        n, sx, sy, sxx, syy, sxy = (
            F.col(f"{y}_{m}").cast("double") for m in ("n", "x", "y", "xx", "yy", "xy")
        )
        spread_x, spread_y = sxx - sx * sx / n, syy - sy * sy / n
        both = sxy - sx * sy / n
        slope = F.when((pair > 0) & (spread_x > 0), both / spread_x)
        full = F.when(spread_y > 0, both * both / (spread_x * spread_y)).otherwise(F.lit(1.0))
        return F.struct(
            F.lit(y).alias("agb_type"),
            pair.alias("n"),
            (slope / 1e4).alias("slope"),
            ((sy - slope * sx) / n / 1e6).alias("intercept"),
            F.when(slope.isNotNull(), full).alias("r2"),
        )

    x = units("agb_tree_kg", 2).try_cast(FIT_UNITS)
    moments = []
    for name in METHODS[1:]:
        y = units(name, 6).try_cast(FIT_UNITS)
        in_pair = x.isNotNull() & y.isNotNull()
        products = {"x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}
        moments.append(F.count_if(in_pair).alias(f"{name}_n"))
        moments += [F.sum(F.when(in_pair, v)).alias(f"{name}_{m}") for m, v in products.items()]
    return trees.agg(*moments).select(F.inline(F.array(*[fit(y) for y in METHODS[1:]])))
