"""Disturbance, fire, tenure and registry metadata per plot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standtally.functions import fixed
from standtally.functions.semantics import as_col, ifelse3, paste, sub_first
from standtally.functions.text import fold_text, plot_key
from standtally.operators.grouped import distinct_concat
from standtally.operators.lookup import first_per_key, lookup_first

REGISTRY = ["tenencia", "anio"]
IMPACT = ["causa"]
FIRE = ["anio_incendio", "tipo_incendio"]
# Three row counts of one plot multiply to more than a whole-number type may hold.
TIMES = "decimal(38,0)"


def disturbance_full_join(registry: DataFrame, impacts: DataFrame, fires: DataFrame) -> DataFrame:
    """Registry, impacts and fires of every plot, with ``n_rows`` for equal combinations.

    All three may hold many rows per plot and the full join is many-to-many. Each side
    first shrinks on the map side to its distinct variants, whose number the value domains
    bound; the multiplicities then multiply, so the result stands for every joined row without
    one plot's copies ever being paired up. The variants of all sides move to their plot
    together, and the result stays there for what groups or joins by plot. Rows without a key
    match none.
    """
    sides = {"_registry": (registry, REGISTRY), "_impacts": (impacts, IMPACT), "_fires": (fires, FIRE)}
    stacked = None
    for name, (df, columns) in sides.items():
        part = df.select("source_code", F.lit(name).alias("_side"), *columns)
        stacked = stacked.unionByName(part, allowMissingColumns=True) if stacked is not None else part
    folded = stacked.groupBy(*stacked.columns).agg(F.count(F.lit(1)).alias("_n"))
    alone = F.when(F.col("source_code").isNull(), F.col("_side"))
    joined = folded.repartition("source_code").groupBy("source_code", alone.alias("_alone")).agg(
        *[
            F.collect_list(F.when(F.col("_side") == name, F.struct(*columns, "_n"))).alias(name)
            for name, (_, columns) in sides.items()
        ]
    )
    times = F.lit(1).cast(TIMES)
    for name in sides:
        joined = joined.withColumn(name, F.explode_outer(name))
        times = (times * F.coalesce(F.col(f"{name}._n"), F.lit(1)).cast("decimal(18,0)")).cast(TIMES)
    values = [F.col(f"{name}.{c}").alias(c) for name, (_, columns) in sides.items() for c in columns]
    return joined.select("source_code", *values, times.alias("n_rows"))


def disturbance_cause(cause: str | Column, fire_type: str | Column) -> Column:
    """Cause text; a fire carries its type."""
    c = as_col(cause)
    return ifelse3(c == fixed.FIRE_CAUSE, paste(c, fire_type, sep="_"), c)


def plot_metadata(
    registry: DataFrame, impacts: DataFrame, fires: DataFrame, disturbances: DataFrame
) -> DataFrame:
    """Disturbance texts per plot, tenure, fire year and survey year."""
    joined = disturbance_full_join(registry, impacts, fires).withColumn(
        "status_es", disturbance_cause("causa", "tipo_incendio")
    )
    translated = lookup_first(
        joined, "status_es", disturbances, "impactos_ambientales", "distubances_en", out="status"
    )
    return translated.groupBy("source_code", "tenencia", "anio_incendio", "anio").agg(
        distinct_concat("status_es").alias("source_vegetation_status_es"),
        distinct_concat("status").alias("source_vegetation_status"),
    )


def ownership_normalize_c3(tenure: str | Column, nucleus: str | Column) -> Column:
    """Land ownership of the third census: fallback, blank text, ordered replacements."""
    t = as_col(tenure)
    unstated = F.lit(False)
    for text in fixed.OWNERSHIP_UNSTATED:
        unstated = unstated | (t == text)
    owner = ifelse3(unstated, as_col(nucleus), t)
    owner = ifelse3(owner == "", F.lit(fixed.OWNERSHIP_BLANK), owner)
    for old, new in fixed.OWNERSHIP_REPLACEMENTS_C3:
        owner = sub_first(owner, old, new)
    return owner


def plot_metadata_c3(registry: DataFrame) -> DataFrame:
    """Registry rows of the third census under the public plot key."""
    return registry.select(
        plot_key("id_conglomerado", "cve_estado_c3", prefix=fixed.KEY_PREFIX).alias("source_code"),
        "cve_estado_c3",
        "upmid",
        F.col("umafor_c3").alias("umafor"),
        F.col("desecon4_c3").alias("ecoregion"),
        F.lit(fixed.MINIMUM_DBH_PLOT).alias("minimum_dbh_plot"),
        ownership_normalize_c3("tenencia_c3", "tip_nuc_c3").alias("land_ownership"),
        fold_text("descrip_s7_c3").alias("source_vegetation_class_es"),
    )


def registry_features(
    registry: DataFrame, states: DataFrame, standardized: bool = False
) -> DataFrame:
    """Registry of all plots: folded state and class, state code, one row per plot.

    The state code matches the raw state names; ``standardized`` compares folded
    standard names instead.
    """
    features = registry.select("source_code", "forest_type", "state", "ecoregion_desecon4")
    one = first_per_key(features, "source_code").withColumns(
        {"state_std": fold_text("state"), "source_veg_class": fold_text("forest_type")}
    )
    if standardized:
        key, dkey = F.replace(F.col("state_std"), F.lit(" "), F.lit("_")), "std_name"
    else:
        key, dkey = F.col("state"), "name"
    return lookup_first(one, key, states, dkey, "code", out="cve_state").select(
        "source_code",
        "forest_type",
        "state",
        "ecoregion_desecon4",
        "state_std",
        "cve_state",
        "source_veg_class",
    )
