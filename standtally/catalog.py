"""Every operator as a query over the test tables: name to (spark, folder) function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from standtally.functions import allometry as A
from standtally.functions import fixed, semantics, text
from standtally.operators import grouped, lookup, wood_density
from standtally.plans import census, compare, metadata, panel, plots, refs, trees
from standtally.plans.spec import CENSUSES
from standtally.sources import schemas, tables
from standtally.sources.staging import new_path
from standtally.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]
Build = Callable[[Workspace], DataFrame]

_BUILDS: dict[str, Build] = {}
_OPEN: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, folder: str) -> Workspace:
    """One workspace per application and folder, so that stages are shared."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, folder)
    return _OPEN[key]


def query(name: str) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        _BUILDS[name] = build
        return build

    return register


def builds() -> dict[str, Build]:
    """Query name to builder over a workspace."""
    return dict(_BUILDS)


def queries() -> dict[str, Query]:
    """Query name to function of session and folder."""

    def bind(build: Build) -> Query:
        return lambda spark, folder: build(workspace(spark, folder))

    return {name: bind(build) for name, build in _BUILDS.items()}


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round computed doubles for comparison between engines."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def over_censuses(build: Callable[[int], DataFrame]) -> DataFrame:
    """The same table of each census, one below the other."""
    parts = [build(k) for k in CENSUSES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Sources and sinks ---------------------------------------------------------------


def _read_csv(k: int) -> Build:
    """A census written as files of two column orders, one of them wider, and read back."""

    def build(w: Workspace) -> DataFrame:
        raw = w.raw_trees(k)
        declared = schemas.schema_of(f"trees_c{k}").fields
        schema = T.StructType([f for f in declared if tables.canonical_name(f.name) in raw.columns])
        names = schema.fieldNames()
        source = raw.select(*[F.col(tables.canonical_name(n)).alias(n) for n in names])
        late = F.pmod(F.xxhash64(*[F.col(f"`{n}`") for n in names]), F.lit(2)) == 1
        path = new_path(w.spark, "trees-csv")
        tables.write_table(source.filter(~late), path, format="csv")
        wider = source.filter(late).select(*reversed(source.columns), F.lit("more").alias("REMARK"))
        tables.write_table(wider, path, format="csv", mode="append")
        return tables.canonical_columns(tables.read_inventory_csv(w.spark, path, schema))

    return build


query("read_inventory_csv")(_read_csv(1))
query("read_inventory_csv_c2")(_read_csv(2))
query("read_inventory_csv_c3")(_read_csv(3))


@query("canonical_columns")
def _(w: Workspace) -> DataFrame:
    source = w.inputs.wood_samples().toDF(*schema_names("wood_samples", skip=["STATE"]))
    return tables.canonical_columns(source)


def schema_names(table: str, skip: list[str]) -> list[str]:
    return [n for n in schemas.schema_of(table).fieldNames() if n not in skip]


@query("write_table")
def _(w: Workspace) -> DataFrame:
    parts = [
        trees.clean_sentinels(w.raw_trees(k), CENSUSES[k]).select(
            F.lit(k).alias("census"), "plot", "subplot", "tag_number", "diameter", "height"
        )
        for k in CENSUSES
    ]
    path = new_path(w.spark, "trees-by-census")
    all_trees = parts[0].unionByName(parts[1]).unionByName(parts[2])
    tables.write_table(all_trees, path, partition_by=["census"])
    return w.spark.read.parquet(path).select(all_trees.columns)


# Projections and predicates -------------------------------------------------------


@query("rename_by_pattern")
def _(w: Workspace) -> DataFrame:
    return tables.rename_by_pattern(
        w.inputs.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus"),
        "^o_",
        "order_",
    )


@query("ifelse3")
def _(w: Workspace) -> DataFrame:
    tall = trees.canonical_trees(w.raw_trees(3), CENSUSES[3]).withColumn(
        "verdict",
        semantics.ifelse3(
            (F.col("diameter") > fixed.MAX_DIAMETER) | (F.col("raw_height") > fixed.MAX_HEIGHT_M),
            F.lit("beyond"),
            F.lit("within"),
        ),
    )
    return tall.groupBy("plot", "verdict").agg(F.count(F.lit(1)).alias("trees"))


@query("coalesce_census")
def _(w: Workspace) -> DataFrame:
    wide = panel.align_censuses(*w.plots())
    return wide.select(
        "source_code",
        panel.coalesce_census(wide, "lat", ["c3", "c2", "c1"]).alias("latitude"),
        panel.coalesce_census(wide, "long", ["c3", "c2", "c1"]).alias("longitude"),
        panel.coalesce_census(wide, "collection_code", ["c1", "c2", "c3"]).alias(
            "collection_code"
        ),
    )


def _sentinels(k: int) -> Build:
    return lambda w: trees.clean_sentinels(w.raw_trees(k), CENSUSES[k]).select(
        "plot", "subplot", "tag_number", "raw_height", "height", "stand_age"
    )


for _k in CENSUSES:
    query(f"clean_sentinels_c{_k}")(_sentinels(_k))


# Joins and lookups ----------------------------------------------------------------


@query("disturbance_full_join")
def _(w: Workspace) -> DataFrame:
    return w.disturbed(1)


@query("align_censuses")
def _(w: Workspace) -> DataFrame:
    columns = ["census_date", "agb_mgha_1", "land_ownership", "source_vegetation_status"]
    return panel.align_censuses(*w.plots()).select(
        "source_code", *[f"{c}_{k}" for k in ("c1", "c2", "c3") for c in columns]
    )


@query("lookup_first")
def _(w: Workspace) -> DataFrame:
    return w.causes(2).select("source_code", "status_es", "status", "n_rows")


@query("lookup_or_self")
def _(w: Workspace) -> DataFrame:
    cleaned = w.long().select(
        "source_code",
        "census",
        text.clean_nbsp("source_vegetation_class_es").alias("class_es"),
    )
    return lookup.lookup_or_self(
        cleaned,
        "class_es",
        w.inputs.vegetation(),
        "source_veg_class_std_es",
        "source_veg_class_en",
        out="class_name",
    )


@query("relabel_census")
def _(w: Workspace) -> DataFrame:
    return w.long().select(
        "source_code",
        "census",
        lookup.relabel("census", fixed.CENSUS_LABELS).alias("which_census"),
        "census_date",
    )


# Aggregations and distinct --------------------------------------------------------


def _site_density(taxon: str) -> Build:
    return lambda w: wood_density.site_taxon_density(w.samples(), taxon)


query("site_species_density")(_site_density("full_species"))
query("site_genus_density")(_site_density("genus"))
query("site_family_density")(_site_density("family"))


@query("plot_rollup_c1")
def _(w: Workspace) -> DataFrame:
    return plots.plot_rollup(w.all_trees(1), CENSUSES[1]).drop("agb_eq1")


@query("plot_rollup_c2")
def _(w: Workspace) -> DataFrame:
    return plots.plot_rollup(w.all_trees(2), CENSUSES[2]).drop("agb_eq1")


@query("plot_rollup_c3")
def _(w: Workspace) -> DataFrame:
    return plots.plot_rollup(w.all_trees(3), CENSUSES[3]).drop(
        "agb_eq1", "agb_eq2", "country", "usage_policy", "stem_level_available"
    )


@query("count_distinct_na")
def _(w: Workspace) -> DataFrame:
    raw = trees.canonical_trees(w.raw_trees(1), CENSUSES[1])
    return raw.groupBy("plot").agg(semantics.count_distinct_na("subplot").alias("subplots"))


@query("distinct_concat")
def _(w: Workspace) -> DataFrame:
    return (
        w.key(w.inputs.impacts(1))
        .groupBy("source_code")
        .agg(
            grouped.distinct_concat("causa").alias("causes"),
            grouped.distinct_concat("causa", keep_na=False).alias("named_causes"),
        )
    )


@query("plot_site_map")
def _(w: Workspace) -> DataFrame:
    return refs.plot_site_map(w.raw_trees(3))


@query("first_per_key")
def _(w: Workspace) -> DataFrame:
    return lookup.first_per_key(w.inputs.plot_registry(), "source_code")


# Windows --------------------------------------------------------------------------


@query("agb_change")
def _(w: Workspace) -> DataFrame:
    return panel.agb_change(w.long()).select(
        "source_code", "census", "census_date", "agb_mgha_1", "year_diff", "agb_change"
    )


@query("agb_change_join")
def _(w: Workspace) -> DataFrame:
    return panel.agb_change(w.long("join")).select(
        "source_code", "census", "census_date", "agb_mgha_1", "year_diff", "agb_change"
    )


@query("agb_change_total")
def _(w: Workspace) -> DataFrame:
    changed = panel.agb_change(w.long("union")).select(
        "source_code", "census", "census_date", "total_year_diff", "agb_change_total"
    )
    return rounded(changed, 6, "agb_change_total")


@query("plot_number_by_collection")
def _(w: Workspace) -> DataFrame:
    return panel.plot_number(w.long("union")).select(
        "collection_code", "source_code", "census", "census_date", "plot_code"
    )


@query("plot_number_global")
def _(w: Workspace) -> DataFrame:
    rollup = plots.plot_rollup(w.all_trees(3), CENSUSES[3]).withColumn(
        "source_code", text.public_key("source_code")
    )
    return panel.plot_number(rollup, within=None).select(
        "collection_code", "source_code", "lat", "long", "census_date", "plot_code"
    )


@query("plot_coordinates")
def _(w: Workspace) -> DataFrame:
    return plots.plot_coordinates(w.keyed(1))


@query("windowed_distinct_count")
def _(w: Workspace) -> DataFrame:
    raw = trees.canonical_trees(w.raw_trees(3), CENSUSES[3]).select(
        "plot", "subplot", "tag_number", "diameter"
    )
    return grouped.windowed_distinct_count(raw, "plot", "subplot", "subplot_count")


@query("group_concat_broadcast")
def _(w: Workspace) -> DataFrame:
    return grouped.group_concat_broadcast(
        w.long("union").select("source_code", "census", "land_ownership", "source_vegetation_class"),
        "source_code",
        {"land_ownership": "owners", "source_vegetation_class": "classes"},
    )


# Reshaping and set operations -----------------------------------------------------


@query("state_dictionary")
def _(w: Workspace) -> DataFrame:
    return refs.state_dictionary(w.raw_trees(3))


@query("census_panel_long")
def _(w: Workspace) -> DataFrame:
    return w.long()


@query("census_panel_union")
def _(w: Workspace) -> DataFrame:
    return w.long("union")


@query("census_panel_join")
def _(w: Workspace) -> DataFrame:
    return w.long("join")


@query("agb_methods_long")
def _(w: Workspace) -> DataFrame:
    return compare.agb_methods_long(
        w.measured().withColumnRenamed("tag_number", "tag"),
        ids=["source_code", "tag", "subplot", "lat", "long"],
    )


# Scalar functions -----------------------------------------------------------------


@query("standardize_name")
def _(w: Workspace) -> DataFrame:
    docs = w.inputs.table("documents")
    return docs.select("doc_id", text.standardize_name("text").alias("std_text"))


@query("fold_text")
def _(w: Workspace) -> DataFrame:
    docs = w.inputs.table("documents")
    return docs.select("doc_id", text.fold_text("text").alias("folded"))


@query("fold_text_signs")
def _(w: Workspace) -> DataFrame:
    signs = F.concat("text", F.lit(" Cañón – El’Alto «Ñandú» “Ærø”… ½ ﬁn: ¿Łódź × þorn?"), "lang")
    return w.inputs.table("documents").select(
        "doc_id", text.fold_text(signs).alias("folded"), text.standardize_name(signs).alias("std_text")
    )


@query("clean_nbsp")
def _(w: Workspace) -> DataFrame:
    spaced = F.concat_ws(text.NBSP, "lang", "source", "text", "lang")
    return w.inputs.table("documents").select("doc_id", text.clean_nbsp(spaced).alias("cleaned"))


@query("state_alias")
def _(w: Workspace) -> DataFrame:
    nation = F.col("c_nationkey")
    name = F.when(nation == 8, F.lit("Ciudad de México")).otherwise(
        F.concat(F.lit("Nuevo León "), nation)
    )
    return w.inputs.table("customer").select(
        "c_custkey", text.state_alias(text.standardize_name(name)).alias("std_name")
    )


@query("plot_key")
def _(w: Workspace) -> DataFrame:
    code = F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey"))
    return w.inputs.table("customer").select(
        "c_custkey",
        text.plot_key("c_custkey", code).alias("source_code"),
        text.plot_key("c_custkey", code, prefix=fixed.KEY_PREFIX).alias("public_code"),
    )


def _species(k: int, literal: bool = False) -> Build:
    return lambda w: w.keyed(k, literal).select(
        "plot", "tag_number", "scientific_name", "genus", "species", "full_species"
    )


query("parse_species")(_species(1))
query("parse_species_c3")(_species(3))
query("parse_species_c3_literal")(_species(3, literal=True))


def _stems(w: Workspace) -> DataFrame:
    """Line items with a density from their part, for the bare equations."""
    parts = w.inputs.table("part").select("p_partkey", (F.col("p_retailprice") / 2000).alias("wd"))
    return (
        w.inputs.table("lineitem")
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "l_orderkey",
            "l_partkey",
            "l_linenumber",
            F.col("l_quantity").alias("d"),
            "wd",
            (F.col("l_discount") * 300).alias("h"),
        )
    )


@query("agb_chave_016")
def _(w: Workspace) -> DataFrame:
    return _stems(w).withColumn("agb_kg", semantics.round_half_up(A.agb_chave_016("d", "wd", "h"), 2)).drop("h")


@query("agb_chave_005")
def _(w: Workspace) -> DataFrame:
    return _stems(w).withColumn("agb_kg", semantics.round_half_up(A.agb_chave_005("d", "wd", "h"), 2)).drop("h")


@query("agb_reported")
def _(w: Workspace) -> DataFrame:
    raw = trees.canonical_trees(w.raw_trees(3), CENSUSES[3])
    return raw.select(
        "plot",
        "tag_number",
        "subplot",
        "reported_kg",
        A.agb_reported("reported_kg", "diameter", "raw_height").alias("agb2_tree_kg"),
    )


@query("plot_area_ha")
def _(w: Workspace) -> DataFrame:
    return (
        w.inputs.table("lineitem")
        .groupBy("l_partkey", "l_returnflag")
        .agg(F.count_distinct("l_linenumber").alias("subplots"))
        .withColumn("plot_area_ha", A.plot_area_ha("subplots"))
    )


@query("agb_per_hectare")
def _(w: Workspace) -> DataFrame:
    stems = _stems(w).withColumn(
        "kg", semantics.round_half_up(A.agb_chave_016("d", F.lit(fixed.DEFAULT_WOOD_DENSITY), "h"), 2)
    )
    return (
        stems.groupBy("l_partkey")
        .agg(
            F.count_distinct("l_linenumber").alias("subplots"),
            (F.round(semantics.sum_fixed("kg", 2) / 1000.0) / 100.0).alias("agb_plot"),
        )
        .withColumn("plot_area_ha", A.plot_area_ha("subplots"))
        .withColumn("agb_mgha_1", A.agb_per_hectare("agb_plot", "plot_area_ha", 2))
    )


@query("collection_code")
def _(w: Workspace) -> DataFrame:
    code = F.when(F.col("c_nationkey") != 7, F.col("c_nationkey") * 2 - 1)
    return w.inputs.table("customer").select(
        "c_custkey", code.alias("state_code"), A.collection_code(code).alias("collection_code")
    )


@query("carbon_and_bgb")
def _(w: Workspace) -> DataFrame:
    priority = F.col("o_orderpriority")
    climate = (
        F.when(priority.isin("1-URGENT", "2-HIGH"), F.lit("Tropical"))
        .when(priority.isin("3-MEDIUM", "4-NOT SPECIFIED"), F.lit("Temperate"))
        .when(F.col("o_orderstatus") == "F", F.lit("Arid"))
    )
    bare = (F.col("o_orderstatus") == "P") & priority.isin("2-HIGH", "3-MEDIUM")
    agb = F.when(bare, F.lit(0.0)).otherwise(F.col("o_totalprice") / 1000)
    mass = w.inputs.table("orders").select(
        "o_orderkey", climate.alias("climate"), A.carbon(agb).alias("carbon_mg")
    )
    return rounded(mass.withColumn("bgb_mg", A.bgb("carbon_mg", "climate")), 6, "bgb_mg")


@query("climate_of_class")
def _(w: Workspace) -> DataFrame:
    return census.climate_of_class(
        w.long("union").select("source_code", "census", "source_vegetation_class_es"),
        w.inputs.vegetation(),
    )


@query("fire_status_year")
def _(w: Workspace) -> DataFrame:
    return w.inputs.fires(1).select(
        "conglomerado",
        "anio",
        "anio_incendio",
        A.fire_status_year("anio_incendio", "anio").alias("fire_year"),
    )


@query("disturbance_cause")
def _(w: Workspace) -> DataFrame:
    return w.causes(1).select("source_code", "causa", "tipo_incendio", "status_es", "n_rows")


@query("ownership_dictionary")
def _(w: Workspace) -> DataFrame:
    return lookup.lookup_first(
        w.inputs.registry(1).select("conglomerado", "tenencia"),
        "tenencia",
        refs.ownership_dictionary(w.spark),
        "land_owner_es",
        "land_owner_en",
        out="land_ownership",
    )


@query("ownership_normalize_c3")
def _(w: Workspace) -> DataFrame:
    return w.inputs.registry_c3().select(
        "id_conglomerado",
        "tenencia_c3",
        "tip_nuc_c3",
        metadata.ownership_normalize_c3("tenencia_c3", "tip_nuc_c3").alias("land_ownership"),
    )


@query("vegetation_status_c3")
def _(w: Workspace) -> DataFrame:
    return w.stored_plots(3).select(
        "source_code", "source_vegetation_class_es", "source_vegetation_status"
    )


@query("registry_features")
def _(w: Workspace) -> DataFrame:
    return w.features()


@query("registry_features_standardized")
def _(w: Workspace) -> DataFrame:
    return w.features(standardized=True)


# Composite operators --------------------------------------------------------------


def _density(k: int, strategy: str) -> Build:
    def build(w: Workspace) -> DataFrame:
        dense = wood_density.assign_wood_density(
            w.keyed(k),
            w.refs.densities,
            epithet=CENSUSES[k].epithet,
            strategy=strategy,
            level_by=CENSUSES[k].level_by,
            codes=w.codes(k, strategy),
        )
        columns = ["source_code", "tag_number", "subplot", "full_species", "family"]
        return rounded(dense.select(*columns, "wood_density", "level_wd"), 6, "wood_density")

    return build


query("wood_density_cascade")(_density(1, "auto"))
query("wood_density_cascade_c2")(_density(2, "auto"))
query("wood_density_cascade_shuffled")(_density(1, "shuffle"))
query("wood_density_cascade_c3")(_density(3, "auto"))
query("wood_density_cascade_c3_shuffled")(_density(3, "shuffle"))


@query("global_wood_density")
def _(w: Workspace) -> DataFrame:
    columns = ["source_code", "tag_number", "subplot", "full_species", "family"]

    def found(k: int) -> DataFrame:
        trees_k = wood_density.global_wood_density(
            w.keyed(k), w.inputs.global_wood_density(), region="Mexico", epithet=CENSUSES[k].epithet
        )
        return trees_k.select(F.lit(k).alias("census"), *columns, "global_wd", "global_level")

    return rounded(over_censuses(found), 6, "global_wd")


@query("name_densities")
def _(w: Workspace) -> DataFrame:
    names = over_censuses(lambda k: w.codes(k).names.withColumn("census", F.lit(k)))
    return rounded(names, 6, "global_wd")


def _tree_agb(k: int) -> Build:
    def build(w: Workspace) -> DataFrame:
        spec = CENSUSES[k]
        out = trees.tree_agb(w.raw_trees(k), spec, w.refs, codes=w.codes(k))
        extra = ["collection_code"] if k == 3 else []
        return rounded(
            out.select(
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
                *spec.methods,
                *extra,
            ),
            6,
            "wood_density",
        )

    return build


for _k in CENSUSES:
    query(f"tree_agb_c{_k}")(_tree_agb(_k))


@query("plot_metadata_c1")
def _(w: Workspace) -> DataFrame:
    return w.metadata(1)


@query("plot_metadata_c2")
def _(w: Workspace) -> DataFrame:
    return w.metadata(2)


@query("plot_metadata_c3")
def _(w: Workspace) -> DataFrame:
    return w.metadata(3)


@query("census_plot_table_c1")
def _(w: Workspace) -> DataFrame:
    return w.plot_table(1)


@query("census_plot_table_c2")
def _(w: Workspace) -> DataFrame:
    return w.plot_table(2)


@query("census_plot_table_c3")
def _(w: Workspace) -> DataFrame:
    return w.plot_table(3)


@query("panel_with_change")
def _(w: Workspace) -> DataFrame:
    return w.panel()


@query("panel_with_change_union")
def _(w: Workspace) -> DataFrame:
    return w.panel("union")


@query("panel_with_change_join")
def _(w: Workspace) -> DataFrame:
    return w.panel("join")


@query("panel_with_change_one_row")
def _(w: Workspace) -> DataFrame:
    return w.panel(one_row_per_census=True)


@query("panel_with_bgb")
def _(w: Workspace) -> DataFrame:
    full = panel.panel_with_bgb(w.panel(), w.inputs.vegetation())
    return rounded(full, 6, "bgb_mg")


@query("class_ownership_history")
def _(w: Workspace) -> DataFrame:
    return panel.class_ownership_history(w.panel()).select(
        "source_code",
        "which_census",
        "census_date",
        "source_forest_type_es",
        "source_forest_type",
        "source_land_ownership",
    )


@query("agb_method_boxstats")
def _(w: Workspace) -> DataFrame:
    return rounded(compare.agb_method_boxstats(w.measured()), 6, "q1", "median", "q3")


@query("agb_method_fit")
def _(w: Workspace) -> DataFrame:
    return rounded(compare.agb_method_fit(w.measured()), 6, "slope", "intercept", "r2")


@query("panel_row_checks")
def _(w: Workspace) -> DataFrame:
    return panel.panel_row_checks(*w.plots(), w.panel())
