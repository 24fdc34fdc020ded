"""Three censuses aligned by plot, and change between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from standtally.functions import fixed
from standtally.functions.semantics import fixed_point, nulls_last
from standtally.functions.text import clean_nbsp
from standtally.operators.grouped import group_concat_broadcast, row_checks
from standtally.operators.lookup import lookup_or_self, relabel
from standtally.operators.ranking import number_plots
from standtally.operators.skew import hot_keys, join_unique
from standtally.plans.census import climate_of_class
from standtally.functions.allometry import bgb, carbon
from standtally.sources.staging import stage

KEY = "source_code"
CENSUS_NAMES = list(fixed.CENSUS_LABELS)

# Within a year, rows go by vegetation class, status and ownership, then by the rest.
TIE_ORDER = ["source_vegetation_class", "source_vegetation_status", "land_ownership"]

REGISTRY_COLUMNS = [
    "forest_type",
    "state",
    "ecoregion_desecon4",
    "state_std",
    "cve_state",
    "source_veg_class",
]


def suffix_columns(df: DataFrame, suffix: str, key: str = KEY) -> DataFrame:
    """Append ``_<suffix>`` to every column but the key."""
    return df.toDF(*[c if c == key else f"{c}_{suffix}" for c in df.columns])


def align_censuses(c1: DataFrame, c2: DataFrame, c3: DataFrame) -> DataFrame:
    """One wide row per combination of a plot's rows in the three censuses.

    Full joins on a merged key lose their partitioning. A spine of distinct keys keeps
    it: all inputs exchange once on the plot key, and so may the change window after.
    """
    tables = dict(zip(CENSUS_NAMES, (c1, c2, c3), strict=True))
    keys = [t.select(KEY) for t in tables.values()]
    wide = keys[0].union(keys[1]).union(keys[2]).distinct()
    for name, table in tables.items():
        wide = wide.join(suffix_columns(table, name), KEY, "left")
    return wide


def coalesce_census(df: DataFrame, column: str, order: list[str]) -> Column:
    """First present value of a column over censuses in the given order."""
    return F.coalesce(*[F.col(f"{column}_{c}") for c in order if f"{column}_{c}" in df.columns])


def _one_per_plot(table: DataFrame) -> DataFrame:
    """The first row of each plot in tie order."""
    rest = [c for c in table.columns if c not in (KEY, *TIE_ORDER)]
    order = F.struct(*nulls_last(*TIE_ORDER), *nulls_last(*rest))
    row = F.min_by(F.struct(*[c for c in table.columns if c != KEY]), order).alias("_row")
    return table.groupBy(KEY).agg(row).select(KEY, "_row.*")


def _measure_types(tables: list[DataFrame]) -> dict[str, str]:
    types: dict[str, str] = {}
    for table in tables:
        for field in table.schema.fields:
            types.setdefault(field.name, field.dataType.simpleString())
    return {m: types.get(m, "string") for m in fixed.PANEL_MEASURES}


def census_panel_long(
    c1: DataFrame, c2: DataFrame, c3: DataFrame, align: str = "union"
) -> DataFrame:
    """Long panel: a row per plot and census, with plot-wide place and collection.

    ``align="union"`` keeps each plot row once, so the panel is as long as its inputs; place
    and collection are the plot's first present values. ``align="join"`` unpivots the wide
    alignment and therefore repeats a census row for every combination of the other
    censuses' rows, whose number is the cube of the rows on a key that plots were pooled on.
    """
    if align == "union":
        return _panel_union([c1, c2, c3])
    types = _measure_types([c1, c2, c3])
    wide = align_censuses(c1, c2, c3)

    def measures(census: str) -> Column:
        values = [
            (F.col(f"{m}_{census}") if f"{m}_{census}" in wide.columns else F.lit(None))
            .cast(kind)
            .alias(m)
            for m, kind in types.items()
        ]
        return F.struct(F.lit(census).alias("census"), *values)

    return wide.select(
        KEY,
        coalesce_census(wide, "lat", ["c3", "c2", "c1"]).alias("latitude"),
        coalesce_census(wide, "long", ["c3", "c2", "c1"]).alias("longitude"),
        coalesce_census(wide, "collection_code", ["c1", "c2", "c3"]).alias("collection_code"),
        F.col("agb_plot_c2"),
        F.inline(F.array(*[measures(c) for c in CENSUS_NAMES])),
    )


def _panel_union(tables: list[DataFrame]) -> DataFrame:
    types = _measure_types(tables)
    parts = [
        t.select(
            KEY,
            "lat",
            "long",
            "collection_code",
            F.lit(name).alias("census"),
            (F.col("agb_plot") if "agb_plot" in t.columns else F.lit(None).cast("double")).alias(
                "agb_plot"
            ),
            *[
                (F.col(m) if m in t.columns else F.lit(None)).cast(kind).alias(m)
                for m, kind in types.items()
            ],
        )
        for name, t in zip(CENSUS_NAMES, tables, strict=True)
    ]
    both = stage(parts[0].unionByName(parts[1]).unionByName(parts[2]), "stacked")

    def plot_wide(value: Column, order: list[str]) -> Column:
        return F.coalesce(*[F.min(F.when(F.col("census") == c, value)) for c in order])

    place = F.when(F.col("lat").isNotNull(), F.struct("lat", "long"))
    per_plot = both.groupBy(KEY).agg(
        plot_wide(place, ["c3", "c2", "c1"]).alias("_place"),
        plot_wide(F.col("collection_code"), ["c1", "c2", "c3"]).alias("_collection"),
        plot_wide(F.col("agb_plot"), ["c2"]).alias("agb_plot_c2"),
    )
    return join_unique(both.drop("agb_plot", "collection_code"), per_plot, [KEY]).select(
        KEY,
        F.col("_place.lat").alias("latitude"),
        F.col("_place.long").alias("longitude"),
        F.col("_collection").alias("collection_code"),
        "agb_plot_c2",
        "census",
        *types,
    )


def panel_order_columns(panel: DataFrame) -> list[str]:
    """A total order of a plot's rows: year, ties, then every other column."""
    first = ["census_date", *TIE_ORDER, "census"]
    rest = [
        c
        for c in [*fixed.PANEL_MEASURES, "latitude", "longitude", "agb_plot_c2"]
        if c in panel.columns and c not in first
    ]
    others = [c for c in panel.columns if c not in (KEY, *first, *rest)]
    return [c for c in [*first, *rest, *others] if c in panel.columns]


def _year_steps(variants: DataFrame, order: Column, spread: bool = True) -> DataFrame:
    """Per plot and year: its first row, and what came before it.

    Rows fold on the map side to the first and the last row of a plot's year; a window
    then runs over the years of a plot, of which there are few, and over no panel rows. Of
    the first row only its stored number goes on. Where no year of a plot is hot, ``spread``
    may be off: rows then move once, to their plot, and not as two ends of their year.
    """
    ends = (variants if spread else variants.repartition(KEY)).groupBy(KEY, "census_date").agg(
        F.min(F.struct(order.alias("o"), F.col("agb_mgha_1").alias("agb"), F.col("_row"))).alias("_first"),
        F.max(F.struct(order.alias("o"), F.col("agb_mgha_1").alias("agb"))).alias("_last"),
    ).select(
        KEY,
        "census_date",
        F.col("_first._row").alias("_first_row"),
        F.col("_first.agb").alias("_first_agb"),
        F.col("_last.agb").alias("_last_agb"),
    )
    years = W.partitionBy(KEY).orderBy(F.col("census_date").asc_nulls_last())
    so_far = years.rowsBetween(W.unboundedPreceding, W.currentRow)
    return ends.select(
        KEY,
        "census_date",
        "_first_row",
        F.lag("census_date").over(years).alias("_before"),
        F.lag("_last_agb").over(years).alias("_agb_before"),
        F.first("census_date").over(so_far).alias("_start"),
        F.first("_first_agb").over(so_far).alias("_agb_start"),
    )


def agb_change(panel: DataFrame) -> DataFrame:
    """Yearly biomass change since the previous row and since the first row of a plot.

    Rows of the same year give a missing change, so only the first row of a plot's year has
    one, since the last row of the year before. Equal rows fold to one with a count, and
    each plot's year to its first and last row; the steps between years join back by plot
    and year, so that a plot with very many rows is spread over tasks. Of equal first rows
    one has the change. Biomass is known to 3 decimals, so the difference is taken in whole
    thousandths and the rounded ratio is exact. The folded rows are stored, which runs a job.
    """
    names = panel.columns
    folded = panel.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    variants = stage(folded.withColumn("_row", F.monotonically_increasing_id()), "panel-variants")
    order = F.struct(*[
        part.alias(f"o{i}")
        for i, part in enumerate(nulls_last(*panel_order_columns(panel)))
    ])
    keys = [KEY, "census_date"]
    hot = hot_keys(variants, keys)
    joined = join_unique(variants, _year_steps(variants, order, hot[0] is not None), keys, hot)
    rows = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    first = (F.col("_copy") == 1) & F.col("_row").eqNullSafe(F.col("_first_row"))
    year_diff = F.col("census_date") - F.when(first, F.col("_before")).otherwise(F.col("census_date"))
    step = (fixed_point("agb_mgha_1", 3) - fixed_point("_agb_before", 3)).cast("double")
    total = F.col("census_date") - F.col("_start")
    change = F.round(F.try_divide(step, year_diff * 10.0)) / 100.0
    return rows.select(
        *names,
        year_diff.alias("year_diff"),
        F.when(first, change).alias("agb_change"),
        total.alias("total_year_diff"),
        F.try_divide(F.col("agb_mgha_1") - F.col("_agb_start"), total.cast("double")).alias("agb_change_total"),
    )


def plot_number(panel: DataFrame, within: str | None = "collection_code") -> DataFrame:
    """Add ``plot_code``, numbering plots inside each collection or over all."""
    return number_plots(panel, KEY, "collection_code", within)


def panel_with_change(
    c1: DataFrame,
    c2: DataFrame,
    c3: DataFrame,
    features: DataFrame,
    vegetation: DataFrame,
    align: str = "union",
    one_row_per_census: bool = False,
) -> DataFrame:
    """The change panel: long form, change, plot codes, constants, classes, registry.

    Rows without biomass leave only after the window, as they take part in it. Plot
    tables are read for their keys and for their rows, so pass stored ones.
    """
    if one_row_per_census:
        c1, c2, c3 = _one_per_plot(c1), _one_per_plot(c2), _one_per_plot(c3)
    long = census_panel_long(c1, c2, c3, align).withColumns(
        {
            "source_vegetation_class": clean_nbsp("source_vegetation_class"),
            "source_vegetation_class_es": clean_nbsp("source_vegetation_class_es"),
        }
    )
    changed = agb_change(long).filter(F.col("agb_mgha_1").isNotNull())
    numbered = plot_number(changed.drop("total_year_diff", "agb_change_total"))
    named = lookup_or_self(
        numbered.drop("source_vegetation_class"),
        "source_vegetation_class_es",
        vegetation,
        "source_veg_class_std_es",
        "source_veg_class_en",
        out="source_vegetation_class",
    )
    measures = [
        m for m in fixed.PANEL_MEASURES if m not in ("subplot_count", "source_vegetation_class")
    ]
    return named.join(features, KEY, "left").select(
        "collection_code",
        "plot_code",
        KEY,
        relabel("census", fixed.CENSUS_LABELS).alias("which_census"),
        *measures,
        "source_vegetation_class",
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("long"),
        "agb_plot_c2",
        "year_diff",
        "agb_change",
        F.lit(fixed.MINIMUM_DBH_PLOT).alias("minimum_dbh_plot"),
        F.lit(fixed.COUNTRY).alias("country"),
        F.lit(fixed.STEM_LEVEL_AVAILABLE).alias("stem_level_available"),
        F.lit(fixed.USAGE_POLICY).alias("usage_policy"),
        *[c for c in features.columns if c != KEY],
    )


def panel_with_bgb(panel: DataFrame, vegetation: DataFrame) -> DataFrame:
    """Add climate, carbon and below-ground biomass; registry columns leave."""
    return (
        climate_of_class(panel, vegetation)
        .withColumn("carbon_mg", carbon("agb_mgha_1"))
        .withColumn("bgb_mg", bgb("carbon_mg", "climate"))
        .drop(*REGISTRY_COLUMNS)
    )


def class_ownership_history(panel: DataFrame) -> DataFrame:
    """Per plot, all its classes and ownerships on every row of the panel."""
    return group_concat_broadcast(
        panel,
        KEY,
        {
            "source_vegetation_class_es": "source_forest_type_es",
            "source_vegetation_class": "source_forest_type",
            "land_ownership": "source_land_ownership",
        },
    )


def panel_row_checks(c1: DataFrame, c2: DataFrame, c3: DataFrame, panel: DataFrame) -> DataFrame:
    """Row and key counts of the inputs, the alignment and the panel.

    The alignment is counted from the rows that each plot has, without pairing them up.
    """
    inputs = [("census1", c1, KEY), ("census2", c2, KEY), ("census3", c3, KEY)]
    plain = row_checks([*inputs, ("panel", panel, KEY)])
    aligned = aligned_counts(c1, c2, c3).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce(F.sum(F.when(F.col(KEY).isNull(), F.col("rows"))), F.lit(0)).cast("bigint").alias("null_keys"),
        F.count(KEY).alias("distinct_keys"),
    )
    return plain.unionByName(aligned.withColumn("stage", F.lit("aligned")))


def aligned_counts(c1: DataFrame, c2: DataFrame, c3: DataFrame) -> DataFrame:
    """Per plot, how many rows the join form of the alignment has: the product of the rows
    of its censuses, each at least one. Rows without a key match none and stand alone."""
    stacked = None
    for i, table in enumerate((c1, c2, c3)):
        part = table.select(KEY, F.lit(i).alias("_i"))
        stacked = part if stacked is None else stacked.unionByName(part)
    per_census = stacked.groupBy(KEY).agg(
        *[F.count_if(F.col("_i") == i).alias(f"_n{i}") for i in range(3)]
    )
    # Products may pass 64 bits on a pooled key.
    product = F.lit(1).cast("decimal(12,0)")
    for i in range(3):
        product = product * F.greatest(F.col(f"_n{i}"), F.lit(1)).cast("decimal(12,0)")
    apart = (F.col("_n0") + F.col("_n1") + F.col("_n2")).cast("decimal(38,0)")
    return per_census.select(
        KEY, F.when(F.col(KEY).isNull(), apart).otherwise(product.cast("decimal(38,0)")).alias("rows")
    )
