"""From raw tree tables to biomass per tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standtally.functions import fixed
from standtally.functions.allometry import (
    agb_chave_005,
    agb_chave_016,
    agb_reported,
    collection_code,
    measured_within,
)
from standtally.functions.semantics import as_col, ifelse3, round_half_up, token_to_number
from standtally.functions.text import parse_species, public_key
from standtally.operators.wood_density import CodedDensities, assign_wood_density
from standtally.plans.refs import Refs, with_plot_key
from standtally.plans.spec import CensusSpec


def clean_height(h: str | Column) -> Column:
    """Height without sentinels."""
    h = as_col(h)
    return ifelse3(h > fixed.MAX_HEIGHT_M, F.lit(None).cast("double"), h)


def clean_age(age: str | Column, rule: str) -> Column:
    """Age without the sentinels of its census, as a number."""
    years = token_to_number(age)
    missing = F.lit(None).cast("double")
    if rule == "zero":
        return F.when(years == 0, missing).otherwise(years)
    if rule == "limit":
        return ifelse3(years > fixed.MAX_AGE_C3, missing, years)
    return years


def canonical_trees(raw: DataFrame, spec: CensusSpec) -> DataFrame:
    """Only the columns the pipeline reads, under our names."""
    return raw.select(*[F.col(source).alias(name) for name, source in spec.columns.items()])


def clean_sentinels(raw: DataFrame, spec: CensusSpec) -> DataFrame:
    """Canonical tree columns with ``height`` and ``stand_age`` cleaned."""
    return canonical_trees(raw, spec).withColumns(
        {"height": clean_height("raw_height"), "stand_age": clean_age("age", spec.age)}
    )


def keyed_trees(raw: DataFrame, spec: CensusSpec, refs: Refs, literal: bool = False) -> DataFrame:
    """Cleaned trees with plot key and parsed species, ready for the density cascade."""
    keyed = with_plot_key(clean_sentinels(raw, spec), "plot", "state_name", refs.states)
    return parse_species(
        keyed, "scientific_name", spec.unknown_marks, hybrid=spec.hybrid, literal=literal
    )


def biomass_columns(spec: CensusSpec) -> dict[str, Column]:
    """Estimates in kg with their labels."""
    h = "raw_height" if spec.raw_height else "height"
    eq1 = round_half_up(agb_chave_016("diameter", "wood_density", h), 2)
    if not spec.raw_height:
        return {"agb_tree_kg": eq1, "agb_eq1": F.lit(fixed.LABEL_EQ1)}
    eq3 = round_half_up(agb_chave_005("diameter", "wood_density", h), 2)
    return {
        "agb_tree_kg": measured_within("diameter", h, eq1),
        "agb2_tree_kg": agb_reported("reported_kg", "diameter", h),
        "agb3_tree_kg": measured_within("diameter", h, eq3, fixed.MAX_HEIGHT_M_EQ3),
        "agb_eq1": F.lit(fixed.LABEL_EQ1),
        "agb_eq2": F.lit(fixed.LABEL_EQ2),
        "agb_eq3": F.lit(fixed.LABEL_EQ3),
        "collection_code": collection_code("state_code"),
    }


def all_trees(
    raw: DataFrame,
    spec: CensusSpec,
    refs: Refs,
    strategy: str = "auto",
    literal: bool = False,
    codes: CodedDensities | None = None,
) -> DataFrame:
    """Every tree row with density and biomass, unmeasured trees included.

    ``codes`` are the census' densities by coded taxon, if they were built before.
    """
    dense = assign_wood_density(
        keyed_trees(raw, spec, refs, literal),
        refs.densities,
        epithet=spec.epithet,
        strategy=strategy,
        level_by=spec.level_by,
        codes=codes,
    )
    return dense.withColumns(biomass_columns(spec))


def tree_agb(
    raw: DataFrame,
    spec: CensusSpec,
    refs: Refs,
    strategy: str = "auto",
    literal: bool = False,
    codes: CodedDensities | None = None,
) -> DataFrame:
    """Tree table of one census with biomass estimates.

    In the third census only trees with a diameter stay and keys carry their prefix.
    """
    trees = all_trees(raw, spec, refs, strategy, literal, codes)
    extra: list[str] = []
    if spec.state_from_code:
        trees = trees.filter(F.col("diameter").isNotNull()).withColumn(
            "source_code", public_key("source_code")
        )
        extra = ["collection_code", "ecoregion", "agb_eq2", "agb_eq3"]
    return trees.select(
        "source_code",
        "subplot",
        "tag_number",
        "census_date",
        "lat",
        "long",
        "family",
        "full_species",
        "wood_density",
        "level_wd",
        "height",
        "stand_age",
        "condition",
        "vegetation",
        *spec.methods,
        "agb_eq1",
        *extra,
    )
