"""Operators against hand-made tables and brute force, hot keys included."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from standtally.operators import grouped, lookup, quantiles, ranking, wood_density
from standtally.plans import compare, metadata, panel, plots
from standtally.plans.spec import CENSUS1, CENSUS3
from standtally.sources import staging, tables
from standtally.sources.schemas import SCHEMAS, schema_of


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_lookup_first_never_multiplies(spark):
    dictionary = spark.createDataFrame(
        [("a", "2"), ("a", "1"), (None, "none")], "k string, v string"
    )
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    got = lookup.lookup_first(df, "x", dictionary, "k", "v")
    assert rows(got) == rows(
        spark.createDataFrame([("a", "1"), ("b", None), (None, "none")], "x string, v string")
    )
    strict = lookup.lookup_first(df, "x", dictionary, "k", "v", null_safe=False)
    assert {r.x: r.v for r in strict.collect()} == {"a": "1", "b": None, None: None}


def test_lookup_or_self_and_relabel(spark):
    dictionary = spark.createDataFrame([("a", "A")], "k string, v string")
    df = spark.createDataFrame([("a",), ("b",)], "x string")
    got = lookup.lookup_or_self(df, "x", dictionary, "k", "v", out="y")
    assert rows(got) == [("a", "A"), ("b", "b")]
    labels = df.select(lookup.relabel("x", {"a": "1"}))
    assert rows(labels) == rows(spark.createDataFrame([("1",), (None,)], "y string"))


def test_first_per_key_with_hot_key(spark):
    data = [("hot", i, str(i)) for i in range(5000)] + [("a", None, "z"), ("a", 7, "y")]
    df = spark.createDataFrame(data, "k string, n int, t string").repartition(7)
    got = lookup.first_per_key(df, "k")
    assert rows(got) == [("a", 7, "y"), ("hot", 0, "0")]
    assert rows(lookup.first_per_key(df, "k", order_by=["t"])) == [("a", 7, "y"), ("hot", 0, "0")]


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_dense_rank_matches_brute_force(spark, partitions):
    rng = random.Random(3)
    data = [("hot", f"k{rng.randrange(900)}") for _ in range(3000)]
    data += [(g, f"k{rng.randrange(50)}") for g in ("a", "b", None) for _ in range(100)]
    df = spark.createDataFrame(data, "g string, k string").repartition(6)
    got = ranking.dense_rank_keys(df, ["g"], "k", "rank", partitions)
    expected = set()
    for group in {g for g, _ in data if g is not None}:
        keys = sorted({k for g, k in data if g == group})
        expected |= {(group, k, i + 1) for i, k in enumerate(keys)}
    assert {tuple(r) for r in got.collect() if r.g is not None} == expected
    over_all = ranking.dense_rank_keys(df.select("k"), [], "k", "rank", partitions)
    keys = sorted({k for _, k in data})
    assert {tuple(r) for r in over_all.collect()} == {(k, i + 1) for i, k in enumerate(keys)}


def test_rank_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, k string")
    assert ranking.dense_rank_keys(empty, ["g"], "k", "rank").count() == 0


def test_plot_numbers(spark):
    df = spark.createDataFrame(
        [("COL212", "INFYS_1_1"), ("COL212", "INFYS_2_1"), ("COL212", "INFYS_1_1"),
         ("COL214", "INFYS_9_2"), (None, "INFYS_7_NA")],
        "collection_code string, source_code string",
    )
    got = rows(panel.plot_number(df))
    assert ("COL212", "INFYS_2_1", "COL212_PL0002") in got
    assert got.count(("COL212", "INFYS_1_1", "COL212_PL0001")) == 2
    assert ("COL214", "INFYS_9_2", "COL214_PL0001") in got
    assert (None, "INFYS_7_NA", "NA_PL0001") in got
    over_all = {tuple(r) for r in panel.plot_number(df, within=None).collect()}
    assert ("COL214", "INFYS_9_2", "COL214_PL0004") in over_all


@pytest.mark.parametrize("n", [1, 2, 4, 1000])
def test_quantiles_match_brute_force(spark, n):
    rng = random.Random(n)
    values = [round(rng.lognormvariate(3, 2), 2) for _ in range(n)] + [0.0] * (n // 2)
    df = spark.createDataFrame(
        [("g", v) for v in values] + [("neg", -v) for v in values] + [("g", None)],
        "g string, v double",
    ).repartition(5)
    counts = quantiles.value_counts(df, "g", "v")
    boxes = quantiles.exact_quantiles(counts, "g", "v", [0.25, 0.5, 0.75])
    got = {r.g: r for r in boxes.collect()}
    for group, sign in (("g", 1), ("neg", -1)):
        series = pd.Series([sign * v for v in values])
        assert got[group].n == len(values)
        for name, p in (("q0", 0.25), ("q1", 0.5), ("q2", 0.75)):
            assert math.isclose(got[group][name], series.quantile(p), abs_tol=1e-9)


def test_boxstats_golden(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, None), (2.0, 2.0, None), (4.0, 3.0, None), (9.0, 5.0, 7.0)],
        "agb_tree_kg double, agb2_tree_kg double, agb3_tree_kg double",
    )
    got = {r.agb_type: r for r in compare.agb_method_boxstats(df).collect()}
    box = got["agb_tree_kg"]
    assert (box.q1, box.median, box.q3) == (1.75, 3.0, 5.25)
    assert (box.whisker_low, box.whisker_high, box.outliers) == (1.0, 9.0, 0)
    assert got["agb3_tree_kg"].n == 1
    fit = {r.agb_type: r for r in compare.agb_method_fit(df).collect()}
    assert fit["agb2_tree_kg"].n == 4 and math.isclose(fit["agb2_tree_kg"].slope, 0.4736842105)


def test_windowed_distinct_count_keeps_rows(spark):
    df = spark.createDataFrame(
        [("p", 1), ("p", 1), ("p", 2), ("p", None), (None, 3)], "k string, s int"
    )
    got = grouped.windowed_distinct_count(df, "k", "s", "n")
    assert got.count() == 5
    assert {(r.k, r.n) for r in got.collect()} == {("p", 3), (None, 1)}


DENSITY_TREES = [
    ("p1", "Quercus laeta", "Quercus", "laeta", "Fagaceae"),
    ("p1", "Quercus rugosa", "Quercus", "rugosa", "Fagaceae"),
    ("p1", "Fagus alta", "Fagus", "alta", "Fagaceae"),
    ("p1", "Pinus teocote", "Pinus", "teocote", "Pinaceae"),
    ("p2", "Pinus otra", "Pinus", "otra", "Pinaceae"),
    ("p2", "Abies rara", "Abies", "rara", "Pinaceae"),
    ("p2", "Nada nada", "Nada", "nada", None),
    ("p2", "Indet sp. sp.", "Aa", "sp.", None),
    ("p3", "NA sp.", None, "sp.", None),
]


@pytest.mark.parametrize("strategy", ["auto", "shuffle"])
def test_cascade_tiers(spark, strategy):
    trees = spark.createDataFrame(
        DENSITY_TREES, "source_code string, full_species string, genus string, species string, family string"
    )
    samples = spark.createDataFrame(
        [
            ("p1", "Quercus laeta", "Quercus", "Fagaceae", 0.7),
            ("p1", "Quercus laeta", "Quercus", "Fagaceae", 0.8),
            ("p1", "Quercus crassa", "Quercus", "Fagaceae", 0.6),
            ("p1", "Quercus rugosa", "Quercus", "Fagaceae", None),
            ("p3", "Some name", None, "Rosaceae", 0.33),
        ],
        "source_code string, full_species string, genus string, family string, wd double",
    )
    table = spark.createDataFrame(
        [
            ("Pinaceae", "Pinus", "teocote", "Mexico", 0.5),
            ("Pinaceae", "Pinus", "teocote", "Mexico", 0.6),
            ("Pinaceae", "Pinus", "ayacahuite", "Mexico", 0.35),
            ("Pinaceae", "Larix", "una", "World", 0.9),
        ],
        "family string, genus string, species string, region string, wd double",
    )
    out = wood_density.wood_density_cascade(
        trees, samples, table, region="Mexico", strategy=strategy
    )
    got = {r.full_species: (round(r.wood_density, 6), r.level_wd) for r in out.collect()}
    assert got == {
        "Quercus laeta": (0.75, "mexico_wd_db"),
        "Quercus rugosa": (0.7, "mexico_wd_db"),
        "Fagus alta": (0.7, "mexico_wd_db"),
        "Pinus teocote": (0.55, "species"),
        "Pinus otra": (0.45, "genus"),
        "Abies rara": (0.45, "family"),
        "Nada nada": (0.48, "mean_mexico"),
        "Indet sp. sp.": (0.48, "mean_mexico"),
        # A missing genus matches a missing genus at the same site.
        "NA sp.": (0.33, "mexico_wd_db"),
    }
    assert out.count() == len(DENSITY_TREES)


TREE_SCHEMA = (
    "source_code string, agb_eq1 string, census_date int, vegetation string, state_name string,"
    " std_state string, subplot int, tag_number int, lat double, long double, agb_tree_kg double,"
    " stand_age double, height double"
)


def test_rollup_with_nothing_measured(spark):
    df = spark.createDataFrame(
        [("1_1", "EQ", 2004, "v", "s", "s", None, 1, 1.0, 2.0, None, None, None),
         ("1_1", "EQ", 2004, "v", "s", "s", 2, 2, 3.0, 4.0, None, 10.0, None)],
        TREE_SCHEMA,
    )
    row = plots.plot_rollup(df, CENSUS1).collect()[0]
    assert (row.agb_plot, row.agb_mgha_1, row.subplot_count) == (0.0, 0.0, 2)
    assert (row.stand_age, row.height) == (10.0, None)
    place = plots.plot_coordinates(df).collect()
    assert [tuple(r) for r in place] == [("1_1", 3.0, 4.0)]


def test_rollup_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    data = [
        ("hot" if i % 3 else f"p{i % 50}", "EQ", 2004, "v", "s", "s", rng.randrange(1, 5), i,
         1.0, 2.0, round(rng.uniform(0, 900), 2), float(rng.randrange(90)), rng.uniform(1, 30))
        for i in range(20000)
    ]
    df = spark.createDataFrame(data, TREE_SCHEMA)
    once = rows(plots.plot_rollup(df.coalesce(2), CENSUS1))
    assert once == rows(plots.plot_rollup(df.repartition(60), CENSUS1))
    assert {r.plot_area_ha for r in plots.plot_rollup(df, CENSUS1).collect()} <= {0.04, 0.08, 0.12, 0.16}


def test_rollup_c3_counts_unmeasured_subplots(spark):
    schema = (
        "source_code string, collection_code string, lat double, long double, census_date int,"
        " agb_eq1 string, agb_eq2 string, subplot int, diameter double, agb_tree_kg double,"
        " agb2_tree_kg double, stand_age double, height double"
    )
    df = spark.createDataFrame(
        [("1_1", "C", 1.0, 1.0, 2015, "a", "b", 1, 10.0, 100.25, 50.125, 10.0, 5.0),
         ("1_1", "C", 1.0, 1.0, 2015, "a", "b", 2, None, None, None, 20.0, 7.0),
         ("1_1", "C", 1.0, 1.0, 2015, "a", "b", 1, 10.0, 100.0, 50.0, None, None),
         ("2_1", "C", 1.0, 1.0, 2015, "a", "b", 1, None, None, None, None, None)],
        schema,
    )
    got = plots.plot_rollup(df, CENSUS3).collect()
    assert len(got) == 1
    row = got[0]
    assert (row.subplot_count, row.plot_area_ha, row.stand_age, row.height) == (2, 0.08, None, 5.0)
    assert (row.agb_plot, row.agb_mgha_1, row.agb2_mgha_1) == (0.20025, 2.503, 1.252)


def test_disturbance_join_stands_for_every_pair(spark):
    registry = spark.createDataFrame([("p", "Ejidal", 2004)] * 2, "source_code string, tenencia string, anio int")
    impacts = spark.createDataFrame(
        [("p", "Tala")] * 300 + [("p", "Incendios"), ("q", None)], "source_code string, causa string"
    )
    fires = spark.createDataFrame(
        [("p", "2003", "De copa")] * 200 + [("r", "1998", None)],
        "source_code string, anio_incendio string, tipo_incendio string",
    )
    joined = metadata.disturbance_full_join(registry, impacts, fires)
    got = {(r.source_code, r.causa): r.n_rows for r in joined.collect()}
    assert got == {("p", "Tala"): 120000, ("p", "Incendios"): 400, ("q", None): 1, ("r", None): 1}
    names = spark.createDataFrame(
        [("Incendios_De copa", "crown fire")], "impactos_ambientales string, distubances_en string"
    )
    meta = {r.source_code: r for r in metadata.plot_metadata(registry, impacts, fires, names).collect()}
    assert meta["p"].source_vegetation_status_es == "Incendios_De copa;Tala"
    assert meta["p"].source_vegetation_status == "NA;crown fire"


CHANGE_SCHEMA = "source_code string, census_date int, agb_mgha_1 double"


def test_change_golden(spark):
    df = spark.createDataFrame(
        [("a", 2005, 10.0), ("a", 2010, 20.0), ("a", 2016, 23.0), ("b", 2005, 1.0), ("b", 2005, 2.0),
         ("c", None, None), ("c", 2009, 5.0)],
        CHANGE_SCHEMA,
    )
    got = panel.agb_change(df).orderBy("source_code", "census_date").collect()
    a = [r for r in got if r.source_code == "a"]
    assert [r.agb_change for r in a] == [None, 2.0, 0.5]
    assert [r.year_diff for r in a] == [None, 5, 6]
    assert [r.agb_change_total and round(r.agb_change_total, 6) for r in a] == [None, 2.0, 1.181818]
    assert all(r.agb_change is None for r in got if r.source_code == "b")
    assert all(r.agb_change is None for r in got if r.source_code == "c")


PLOT_SCHEMA = (
    "collection_code string, source_code string, lat double, long double, census_date int,"
    " agb_mgha_1 double, source_vegetation_class string, source_vegetation_class_es string,"
    " source_vegetation_status string, land_ownership string, agb_plot double"
)


def _plot(code, year, agb, status="s"):
    return ("COL212", code, 1.0, 2.0, year, agb, None, "bosque de pino", status, "ejido", 0.5)


def _three(spark):
    c1 = spark.createDataFrame([_plot("a", 2004, 10.0), _plot("a", 2004, 10.0, "t")], PLOT_SCHEMA)
    c2 = spark.createDataFrame([_plot("a", 2009, 20.0), _plot("b", 2009, 5.0)], PLOT_SCHEMA)
    c3 = spark.createDataFrame([_plot("a", 2015, 26.0), _plot("c", 2015, None)], PLOT_SCHEMA)
    return c1.drop("agb_plot"), c2, c3.drop("agb_plot")


def test_alignments(spark):
    tables3 = _three(spark)
    wide = panel.align_censuses(*tables3)
    assert wide.count() == 4
    joined = panel.census_panel_long(*tables3, align="join")
    assert joined.count() == 3 * wide.count()
    assert joined.filter(F.col("agb_mgha_1").isNotNull()).count() == 7
    union = panel.census_panel_long(*tables3, align="union")
    assert union.count() == 6
    assert {r.agb_plot_c2 for r in union.filter("source_code = 'a'").collect()} == {0.5}


def test_panel_and_carbon(spark):
    vegetation = spark.createDataFrame(
        [("Pine forest", "bosque de pino", "Temperate")],
        "source_veg_class_en string, source_veg_class_std_es string, climate string",
    )
    features = spark.createDataFrame(
        [("a", "f", "s", "e", "s", 1, "v")],
        "source_code string, forest_type string, state string, ecoregion_desecon4 string,"
        " state_std string, cve_state int, source_veg_class string",
    )
    tables3 = _three(spark)
    whole = panel.panel_with_change(*tables3, features, vegetation, align="join")
    one = panel.panel_with_change(
        *tables3, features, vegetation, align="join", one_row_per_census=True
    )
    union = panel.panel_with_change(
        *tables3, features, vegetation, align="union", one_row_per_census=True
    )
    assert rows(one) == rows(union) and whole.count() == 7
    a = {r.which_census: r for r in one.collect() if r.source_code == "a"}
    assert [a[k].agb_change for k in "123"] == [None, 2.0, 1.0]
    assert a["1"].plot_code == "COL212_PL0001"
    assert {r.source_vegetation_class for r in whole.collect()} == {"Pine forest"}
    carbon = {r.which_census: r for r in panel.panel_with_bgb(one, vegetation).collect()
              if r.source_code == "a"}
    assert round(carbon["1"].carbon_mg, 6) == 4.7 and carbon["1"].climate == "Temperate"
    assert not set(panel.REGISTRY_COLUMNS) & set(panel.panel_with_bgb(one, vegetation).columns)
    history = panel.class_ownership_history(whole)
    assert {r.source_land_ownership for r in history.collect()} == {"ejido"}
    checks = {r.stage: r.rows for r in panel.panel_row_checks(*tables3, whole).collect()}
    assert checks == {"census1": 2, "census2": 2, "census3": 2, "aligned": 4, "panel": 7}


def test_row_checks_count_missing_keys(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "k string")
    row = grouped.row_checks([("t", df, "k")]).collect()[0]
    assert (row.rows, row.null_keys, row.distinct_keys) == (3, 1, 1)


def test_csv_round_trip(spark, tmp_path):
    schema = schema_of("impacts")
    data = [(1, "México", "Plagas"), (2, "", None), (3, 'says "NA"', "a,b")]
    df = spark.createDataFrame(data, schema)
    tables.write_table(df, str(tmp_path / "csv"), format="csv")
    back = tables.read_inventory_csv(spark, str(tmp_path / "csv"), schema)
    assert rows(back) == rows(df)


def test_csv_keeps_what_parses(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("Conglomerado,Estado,Causa\n1,x,y\nnope,x,y\n")
    got = tables.read_inventory_csv(
        spark, str(tmp_path / "bad.csv"), schema_of("impacts"), keep_corrupt=True
    ).collect()
    assert [(r.Conglomerado, r.Estado) for r in got] == [(1, "x"), (None, "x")]
    assert [r[tables.CORRUPT] for r in got] == [None, "nope,x,y"]


def test_csv_binds_by_header_name(spark, tmp_path):
    text = "Folio,Causa,Conglomerado,Nota,Estado,Causa\n77,Plagas,1,n,Jalisco,otra\n78,NA, 2 ,,,x\n79,,x1,,NA,y\n"
    (tmp_path / "wide.csv").write_text(text)
    got = tables.read_inventory_csv(spark, str(tmp_path / "wide.csv"), schema_of("impacts"))
    assert got.columns == ["Conglomerado", "Estado", "Causa"]
    assert rows(got) == rows(
        spark.createDataFrame([(1, "Jalisco", "Plagas"), (2, "", None), (None, None, "")], schema_of("impacts"))
    )
    (tmp_path / "narrow.csv").write_text("Conglomerado,Causa\n1,x\n")
    with pytest.raises(ValueError, match="Estado"):
        tables.read_inventory_csv(spark, str(tmp_path / "narrow.csv"), schema_of("impacts"))


def test_full_join_counts_beyond_whole_numbers(spark):
    n = 3_000_000
    key = F.lit("NA_NA").alias("source_code")
    text = lambda *names: [F.lit("v").alias(c) for c in names]
    many = spark.range(n)
    joined = metadata.disturbance_full_join(
        many.select(key, *text("tenencia"), F.lit(2004).alias("anio")),
        many.select(key, *text("causa")),
        many.select(key, *text("anio_incendio", "tipo_incendio")),
    ).collect()
    assert [int(r.n_rows) for r in joined] == [n**3]


def test_canonical_names(spark):
    names = ["UPMID SITE CODE", "BASIC WOOD DENSITY (g/cm3)", "NombreCientifico_APG_C3", "IDConglomerado"]
    df = tables.canonical_columns(spark.createDataFrame([(1, 0.5, "a", 2)], names))
    assert df.columns == [
        "upmid_site_code", "basic_wood_density_g_cm3", "nombre_cientifico_apg_c3", "id_conglomerado",
    ]
    assert df.schema["upmid_site_code"].metadata == {"source_name": "UPMID SITE CODE"}
    twice = spark.createDataFrame([(1, 2)], ["a b", "A_B"])
    assert tables.canonical_columns(twice).columns == ["a_b", "a_b_2"]


def test_schemas_parse():
    for name in SCHEMAS:
        assert schema_of(name).fieldNames()


def test_rename_by_pattern(spark):
    df = spark.createDataFrame([(1, 2)], ["lat.x", "lat.y"])
    out = tables.rename_by_pattern(tables.rename_by_pattern(df, r"\.x$", "_c1"), r"\.y$", "_c2")
    assert out.columns == ["lat_c1", "lat_c2"]


def test_size_check(spark):
    assert staging.fits_broadcast(spark.range(10), 10)
    assert not staging.fits_broadcast(spark.range(11), 10)
    wide = spark.range(10).select(F.repeat(F.lit("x"), 8_000_000).alias("t"))
    assert not staging.fits_broadcast(wide, 10)
