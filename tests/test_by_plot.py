"""Work that moves rows to their plot once."""

import random

from pyspark.sql import functions as F

from standtally.operators import skew
from standtally.operators import wood_density as wd
from standtally.plans import metadata, panel
from standtally.sources import staging
from tests.test_codes import SAMPLES, some_samples
from tests.test_names import TABLE, TREES, sample


def exchanges(df):
    return df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_many_sites_and_few_taxa_move_trees_once(spark, monkeypatch):
    rng = random.Random(9)
    trees, table = sample(rng)
    trees += [(1000, None, None, None, None, None), (1001, "1_1", None, "Quercus", None, None)]
    samples = some_samples(rng, trees)
    args = [spark.createDataFrame(*a) for a in ((trees, TREES), (samples, SAMPLES), (table, TABLE))]
    want = {r.id: (round(r.wood_density, 9), r.level_wd) for r in wd.wood_density_cascade(*args).collect()}
    real = wd.fits_broadcast
    monkeypatch.setattr(wd, "fits_broadcast", lambda df, *a: "level" not in df.columns and real(df))
    some = sorted({t[1] for t in trees if t[1]})[:2]
    for hot in ([], some):
        monkeypatch.setattr(wd, "hot_values", lambda *a, hot=hot: hot)
        df = wd.wood_density_cascade(*args)
        assert {r.id: (round(r.wood_density, 9), r.level_wd) for r in df.collect()} == want
        assert df.count() == len(trees)
        if not hot:
            # One exchange of the trees, one of the sites; what groups by plot needs no other.
            assert exchanges(df) == 2 and exchanges(df.groupBy("source_code", "level_wd").count()) == 2


def test_site_means_survive_packing(spark):
    rows = [("1_1", "a=b c", "a=b", None, 0.5), ("1_1", None, "a=b", None, 0.7), ("1_1", "x y", None, "f", None), (None, "x y", "x", "f", 0.1)]
    samples = spark.createDataFrame(rows, SAMPLES)
    unpacked = wd.unpacked_site_densities(wd.packed_site_densities(samples))
    plain = wd.site_density_levels(samples).select(unpacked.columns)
    assert sorted(map(str, unpacked.collect())) == sorted(map(str, plain.collect()))


def test_ingest_runs_its_input_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = spark.range(500).mapInPandas(count, "id long").repartition(16, "id")
    assert staging.ingest(rows, "once", 16).count() == 500 and read.value == 500


def test_metadata_moves_to_its_plot_once_for_all_sides(spark):
    registry = spark.createDataFrame([("a", "E", 2004), ("a", "E", 2004), (None, "N", 1)], "source_code string, tenencia string, anio int")
    impacts = spark.createDataFrame([("a", "T"), ("a", None), (None, "T")], "source_code string, causa string")
    fires = spark.createDataFrame([("b", "2003", None)], "source_code string, anio_incendio string, tipo_incendio string")
    joined = metadata.disturbance_full_join(registry, impacts, fires)
    got = {(*r[:-1], int(r[-1])) for r in joined.collect()}
    assert got == {
        ("a", "E", 2004, "T", None, None, 2),
        ("a", "E", 2004, None, None, None, 2),
        ("b", None, None, None, "2003", None, 1),
        (None, "N", 1, None, None, None, 1),
        (None, None, None, "T", None, None, 1),
    }
    # To fold the variants, and to bring them to their plot, where grouping finds them.
    assert exchanges(joined.groupBy("source_code").count()) == 2


def test_numbered_rows_stay_at_their_plot(spark):
    rows = [("p1", "X"), ("p2", "X"), ("p2", "Y"), (None, "X"), ("p0", None)]
    plots = spark.createDataFrame(rows, "source_code string, collection_code string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        numbered = panel.plot_number(plots)
        # Grouping by plot needs no exchange beyond those of the join with the ranks.
        assert exchanges(numbered.groupBy("source_code", "plot_code").count()) == exchanges(numbered)
        got = {tuple(r) for r in numbered.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(k, c): n for k, c, n in got if k} == {
        ("p1", "X"): "X_PL0001", ("p2", "X"): "X_PL0002", ("p2", "Y"): "Y_PL0001", ("p0", None): "NA_PL0001"
    }


def test_rows_of_hot_values_are_found_and_joined(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 2000)
    many = spark.range(8000).select(F.when(F.col("id") % 4 == 0, "h").when(F.col("id") % 4 == 1, F.col("id").cast("string")).alias("k"), "id")
    assert skew.hot_values(many, "k") == ["h"]
    one = spark.createDataFrame([("h", 1), ("5", 2), (None, 3)], "k string, v int")
    got = {r.id: r.v for r in skew.join_spread(many, one, "k", ["h"]).collect()}
    assert got == {i: 1 if i % 4 == 0 else 2 if i == 5 else None for i in range(8000)}


def test_joined_rows_stay_at_their_key(spark):
    many = spark.createDataFrame([(f"k{i % 2500}", i % 3, i) for i in range(5000)], "k string, d int, i int")
    one = spark.createDataFrame([("k8", 3), ("z", 4)], "k string, v int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = skew.join_unique(many, one, ["k"])
        assert exchanges(joined.groupBy(*joined.columns).count()) == exchanges(joined) == 2
        panel_rows = many.select(F.col("k").alias("source_code"), F.col("d").alias("census_date"), F.col("i").cast("double").alias("agb_mgha_1"), F.col("i").alias("_row"))
        steps = panel._year_steps(panel_rows, F.struct("agb_mgha_1"), spread=False)
        assert exchanges(steps) == 1
        assert sorted(map(str, steps.collect())) == sorted(map(str, panel._year_steps(panel_rows, F.struct("agb_mgha_1")).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
