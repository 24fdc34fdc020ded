"""Trees rolled up to plots, and plot coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from standtally.functions import fixed
from standtally.functions.allometry import per_hectare, plot_area_ha
from standtally.functions.semantics import (
    count_distinct_na,
    mean_from_sums,
    units,
)
from standtally.plans.spec import CensusSpec

# Means of ages and heights keep 4 decimals of each value; reported biomass keeps 6. Values
# that are undefined, or too large for the types that are summed, count as missing.
MEAN_SCALE = 4
REPORTED_DECIMAL = "decimal(28,6)"


def first_place() -> Column:
    """Aggregate over rows that hold the lowest tag of their place: the first tree of the
    lowest subplot, as a struct of subplot, tag, lat, long."""
    place = F.struct("subplot", "_tag", "lat", "long")
    return F.min(F.when(F.col("subplot").isNotNull(), place))


def plot_coordinates(trees: DataFrame) -> DataFrame:
    """One coordinate pair per plot.

    A minimum over structs cannot be hash-aggregated, so trees first shrink by hash to
    the places of a plot with their lowest tags.
    """
    places = trees.groupBy("source_code", "subplot", "lat", "long").agg(
        F.min("tag_number").alias("_tag")
    )
    return (
        places.groupBy("source_code")
        .agg(first_place().alias("_c"))
        .filter(F.col("_c").isNotNull())
        .select("source_code", F.col("_c.lat").alias("lat"), F.col("_c.long").alias("long"))
    )


def plot_rollup(trees: DataFrame, spec: CensusSpec, coordinates: bool = False) -> DataFrame:
    """Plot totals of one census from its tree rows, unmeasured trees included.

    ``coordinates`` adds the ``_c`` struct of ``first_place`` per output row.
    """
    out = _rollup_all_subplots(trees, spec) if spec.all_subplots else _rollup(
        trees, spec, coordinates
    )
    return out.withColumnRenamed("vegetation", "source_veg_class_raw")


def _rollup(trees: DataFrame, spec: CensusSpec, coordinates: bool) -> DataFrame:
    """Two hash aggregates: trees to subplots, where map-side combine folds even a hot
    plot into a few rows, then subplots to plots."""
    keys = ["source_code", *spec.labels, "census_date", *spec.group_extra]
    place = ["subplot", "lat", "long"] if coordinates else ["subplot"]
    subplots = trees.groupBy(*keys, *place).agg(
        F.sum(units("agb_tree_kg", 2)).alias("_kg"),
        F.sum(units("stand_age", MEAN_SCALE)).alias("_age"),
        F.count(units("stand_age", MEAN_SCALE)).alias("_ages"),
        F.sum(units("height", MEAN_SCALE)).alias("_height"),
        F.count(units("height", MEAN_SCALE)).alias("_heights"),
        *([F.min("tag_number").alias("_tag")] if coordinates else []),
    )

    def mean(total: str, n: str) -> Column:
        return mean_from_sums(F.sum(total), F.sum(n), 2, MEAN_SCALE)

    kg100 = F.coalesce(F.sum("_kg"), F.lit(0)).cast("double")
    # Without places every subplot is one row already, a missing one included.
    n = count_distinct_na("subplot") if coordinates else F.count(F.lit(1))
    return (
        subplots.groupBy(*keys)
        .agg(
            n.alias("subplot_count"),
            (F.round(kg100 / 1000.0) / 100.0).alias("agb_plot"),
            mean("_age", "_ages").alias("stand_age"),
            mean("_height", "_heights").alias("height"),
            *([first_place().alias("_c")] if coordinates else []),
        )
        .withColumn("plot_area_ha", plot_area_ha("subplot_count"))
        .withColumn(
            "agb_mgha_1",
            per_hectare(F.round(F.col("agb_plot") * 100.0), 100.0, "plot_area_ha",
                        spec.hectare_digits),
        )
    )


def _rollup_all_subplots(trees: DataFrame, spec: CensusSpec) -> DataFrame:
    """Rollup whose subplot count also sees trees without a diameter.

    Trees are read once: they fold to their keys and subplot, with sums over measured trees
    only. These few rows carry both results. The distinct subplots of a plot are ranked over
    them, and the sums add up by key, on the same exchange by plot.
    """
    keys = ["source_code", *spec.labels, "census_date", *spec.group_extra]
    measured = F.col("diameter").isNotNull()

    def of(c: Column) -> Column:
        return F.when(measured, c)

    height = units("height", MEAN_SCALE)
    age_units = units("stand_age", MEAN_SCALE)
    subplots = trees.groupBy(*keys, "subplot").agg(
        F.sum(of(units("agb_tree_kg", 2))).alias("_kg"),
        F.sum(of(F.col("agb2_tree_kg").try_cast(REPORTED_DECIMAL))).alias("_kg_reported"),
        F.sum(of(age_units)).alias("_age"),
        F.count(of(age_units)).alias("_ages"),
        F.sum(of(height)).alias("_height"),
        F.count(of(height)).alias("_heights"),
        F.count(of(F.lit(1))).alias("_rows"),
    )
    plot = W.partitionBy("source_code")
    # A missing subplot ranks as one value.
    ranked = subplots.withColumn("_rank", F.dense_rank().over(plot.orderBy("subplot")))
    counted = ranked.withColumn("subplot_count", F.max("_rank").over(plot).cast("bigint"))
    sums = (
        counted.groupBy(*keys)
        .agg(
            F.max("subplot_count").alias("subplot_count"),
            F.coalesce(F.sum("_kg"), F.lit(0)).alias("_kg100"),
            F.coalesce(F.sum("_kg_reported"), F.lit(0)).alias("_kg2"),
            *[F.sum(c).alias(c) for c in ("_age", "_ages", "_height", "_heights", "_rows")],
        )
        .filter("_rows > 0")
        .withColumn("height", mean_from_sums(F.col("_height"), F.col("_heights"), 2, MEAN_SCALE))
        # Plots without a key have no count to meet.
        .filter(F.col("source_code").isNotNull())
    )
    age = mean_from_sums(F.col("_age"), F.col("_ages"), 2, MEAN_SCALE)
    if spec.strict_age_mean:
        age = F.when(F.col("_ages") == F.col("_rows"), age)
    kg2 = F.col("_kg2").cast("double")
    return (
        sums.withColumn("plot_area_ha", plot_area_ha("subplot_count"))
        .select(
            *keys,
            "subplot_count",
            (F.col("_kg100").cast("double") / 1e5).alias("agb_plot"),
            (kg2 / 1000.0).alias("agb2_plot"),
            age.alias("stand_age"),
            "height",
            "plot_area_ha",
            per_hectare("_kg100", 1e5, "plot_area_ha", spec.hectare_digits).alias("agb_mgha_1"),
            per_hectare(F.round(kg2 * 1e6), 1e9, "plot_area_ha", spec.hectare_digits).alias(
                "agb2_mgha_1"
            ),
            F.lit(fixed.COUNTRY).alias("country"),
            F.lit(fixed.USAGE_POLICY).alias("usage_policy"),
            F.lit(fixed.STEM_LEVEL_AVAILABLE).alias("stem_level_available"),
        )
    )
