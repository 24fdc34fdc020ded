"""Plot tables of the three censuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from standtally.functions import fixed
from standtally.functions.allometry import collection_code, fire_status_year
from standtally.functions.text import clean_nbsp, public_key, vegetation_status
from standtally.operators.lookup import lookup_first
from standtally.operators.ranking import number_plots
from standtally.plans.plots import plot_rollup
from standtally.plans.refs import Refs
from standtally.plans.spec import CensusSpec


def climate_of_class(
    df: DataFrame, vegetation: DataFrame, key: str = "source_vegetation_class_es"
) -> DataFrame:
    """Add the climate of a vegetation class."""
    return lookup_first(df, key, vegetation, "source_veg_class_std_es", "climate")


def english_class(df: DataFrame, vegetation: DataFrame, key: str, out: str) -> DataFrame:
    """Add the English name of a vegetation class."""
    return lookup_first(
        df, key, vegetation, "source_veg_class_std_es", "source_veg_class_en", out=out
    )


def census_plot_table(
    trees: DataFrame, metadata: DataFrame, refs: Refs, spec: CensusSpec
) -> DataFrame:
    """Plot table of the first or second census from its trees and metadata.

    Coordinates ride along in the rollup, so trees are read once; the exchange on the
    plot key that picks them also serves the metadata join. Metadata keyed finer than the
    plot multiplies its rows, as each variant is a result row.
    """
    per_plot = W.partitionBy("source_code")
    rollup = plot_rollup(trees, spec, coordinates=True).withColumn(
        "_c", F.min("_c").over(per_plot)
    )
    joined = rollup.join(metadata, "source_code", "left").withColumns(
        {
            "lat": F.col("_c.lat"),
            "long": F.col("_c.long"),
            "source_vegetation_class_es": F.lower("source_veg_class_raw"),
            "source_vegetation_status_year": fire_status_year("anio_incendio", "anio"),
        }
    )
    classed = english_class(
        joined, refs.vegetation, "source_vegetation_class_es", "source_vegetation_class"
    )
    owned = lookup_first(
        classed, "tenencia", refs.ownership, "land_owner_es", "land_owner_en", out="land_ownership"
    )
    coded = lookup_first(owned, "std_state", refs.states, "std_name", "code", out="state_code")
    return coded.withColumns(
        {
            "collection_code": collection_code("state_code"),
            "source_code": public_key("source_code"),
        }
    ).select(
        "collection_code",
        "source_code",
        "lat",
        "long",
        "census_date",
        "agb_mgha_1",
        "agb_eq1",
        "source_vegetation_class",
        "source_vegetation_class_es",
        "stand_age",
        "height",
        "plot_area_ha",
        "source_vegetation_status_es",
        "source_vegetation_status",
        "source_vegetation_status_year",
        "land_ownership",
        *spec.carries,
    )


def census_plot_table_c3(
    trees: DataFrame,
    metadata: DataFrame,
    refs: Refs,
    spec: CensusSpec,
    disturbances: DataFrame | None = None,
    counted: bool = False,
) -> DataFrame:
    """Plot table of the third census; ``disturbances`` has source_code, disturbance_en.

    Registry and disturbance rows fold on the map side to their distinct variants before
    they meet plots, so copies of them do not multiply the result; ``n_rows`` tells how many
    pairs of registry and disturbance row a result row stands for. Variants that differ
    each give a row. With ``counted`` off the number is left out.
    """
    metadata = variants(metadata, "_registry_rows")
    rollup = plot_rollup(trees, spec).withColumn("source_code", public_key("source_code"))
    numbered = number_plots(rollup, "source_code", "collection_code", within=None)
    joined = numbered.join(metadata, "source_code", "left").filter(
        F.col("collection_code").isNotNull()
    )
    classed = english_class(
        joined.withColumn("source_vegetation_class_es", clean_nbsp("source_vegetation_class_es")),
        refs.vegetation,
        "source_vegetation_class_es",
        "source_vegetation_class",
    )
    if disturbances is None:
        disturbed = classed.withColumn("disturbance_en", F.lit(None).cast("string")).withColumn(
            "_disturbance_rows", F.lit(None).cast("bigint")
        )
    else:
        hits = variants(disturbances.select("source_code", "disturbance_en"), "_disturbance_rows")
        disturbed = classed.join(hits, "source_code", "left")
    secondary = F.when(
        F.col("source_vegetation_class_es").contains(fixed.SECONDARY_VEGETATION_ES),
        F.lit(fixed.SECONDARY_VEGETATION),
    )
    one = F.lit(1).cast("bigint")
    n_rows = (F.coalesce("_registry_rows", one) * F.coalesce("_disturbance_rows", one)).alias("n_rows")
    return disturbed.withColumn(
        "source_vegetation_status", vegetation_status("disturbance_en", secondary)
    ).select(
        "collection_code",
        "plot_code",
        "source_code",
        "lat",
        "long",
        "agb_mgha_1",
        "agb2_mgha_1",
        "agb_eq1",
        "agb_eq2",
        "census_date",
        "subplot_count",
        "stand_age",
        "height",
        "plot_area_ha",
        "country",
        "usage_policy",
        "stem_level_available",
        "cve_estado_c3",
        "upmid",
        "umafor",
        "ecoregion",
        "minimum_dbh_plot",
        "land_ownership",
        "source_vegetation_class_es",
        "source_vegetation_class",
        "source_vegetation_status",
        *([n_rows] if counted else []),
    )


def variants(df: DataFrame, count: str) -> DataFrame:
    """The distinct rows of a table with their number."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(count))
