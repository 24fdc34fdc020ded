"""Dictionaries that every census shares, built once and staged with a known size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from standtally.functions import fixed
from standtally.functions.text import plot_key, standardize_name, state_alias
from standtally.operators.lookup import lookup_first
from standtally.operators.wood_density import DensityTables, density_tables
from standtally.sources.staging import literal_table, stage


def state_dictionary(trees_c3: DataFrame) -> DataFrame:
    """Distinct states of the third census with a standard name, plus the alias rows."""
    observed = (
        trees_c3.filter(F.col("cve_estado_c3").isNotNull())
        .select(
            F.col("cve_estado_c3").cast("int").alias("code"), F.col("estado_c3").alias("name")
        )
        .distinct()
        .withColumn("std_name", state_alias(standardize_name("name", rare=False)))
    )
    aliases = literal_table(
        trees_c3.sparkSession, fixed.STATE_ALIASES, "code int, name string, std_name string"
    )
    return observed.unionByName(aliases)


def plot_site_map(trees_c3: DataFrame) -> DataFrame:
    """Distinct site, plot and state of the third census with the plot key."""
    return (
        trees_c3.select(
            F.col("upmid"),
            F.col("id_conglomerado").alias("plot"),
            F.col("cve_estado_c3").alias("code"),
        )
        .distinct()
        .withColumn("source_code", plot_key("plot", "code"))
    )


def ownership_dictionary(spark: SparkSession) -> DataFrame:
    """Ownership, Spanish to English."""
    return literal_table(spark, fixed.OWNERSHIP, "land_owner_es string, land_owner_en string")


def site_samples(wood_samples: DataFrame, sites: DataFrame) -> DataFrame:
    """Wood samples keyed by plot; samples of unmapped sites drop out."""
    keyed = lookup_first(
        wood_samples, "upmid_site_code", sites, "upmid", "source_code", order_by=["plot", "code"]
    )
    return keyed.filter(F.col("source_code").isNotNull()).select(
        "source_code",
        F.col("species").alias("full_species"),
        "genus",
        "family",
        F.col("basic_wood_density_g_cm3").alias("wd"),
    )


def with_plot_key(df: DataFrame, plot: str, state_name: str, states: DataFrame) -> DataFrame:
    """Add ``std_state``, ``state_id`` and ``source_code`` from plot number and state name.

    State names keep ``RARE_SIGNS``, here and in the dictionary of states.
    """
    named = df.withColumn("std_state", standardize_name(state_name, rare=False))
    return lookup_first(
        named, "std_state", states, "std_name", "code", out="state_id"
    ).withColumn("source_code", plot_key(plot, "state_id"))


@dataclass(frozen=True)
class Refs:
    """Shared tables: states, density means, dictionaries."""

    states: DataFrame
    densities: DensityTables
    vegetation: DataFrame
    disturbances: DataFrame
    ownership: DataFrame


def build_refs(
    trees_c3: DataFrame,
    wood_samples: DataFrame,
    global_wd: DataFrame,
    vegetation: DataFrame,
    disturbances: DataFrame,
    region: str | None = None,
    states: DataFrame | None = None,
) -> Refs:
    """Derive the state dictionary, the site map and the density means once.

    They are staged: the join planner then sees their true size and broadcasts only what
    is small, however large the tables they came from.
    """
    spark = trees_c3.sparkSession
    sites = stage(plot_site_map(trees_c3), "plot-sites")
    return Refs(
        states=stage(state_dictionary(trees_c3), "states") if states is None else states,
        densities=density_tables(site_samples(wood_samples, sites), global_wd, region),
        vegetation=vegetation,
        disturbances=disturbances,
        ownership=ownership_dictionary(spark),
    )
