"""Densities by coded taxon, and group texts that read their rows once."""

import random

import pytest
from pyspark.sql import functions as F

from standtally.operators import grouped
from standtally.operators import wood_density as wd
from tests.test_names import TABLE, TREES, sample

SAMPLES = "source_code string, full_species string, genus string, family string, wd double"


def densities(spark, trees, samples, table, **options):
    df = wd.wood_density_cascade(
        spark.createDataFrame(trees, TREES),
        spark.createDataFrame(samples, SAMPLES),
        spark.createDataFrame(table, TABLE),
        **options,
    )
    return df, {r.id: (round(r.wood_density, 9), r.level_wd) for r in df.collect()}


def some_samples(rng, trees):
    out = []
    for i, site, full, genus, _, family in rng.sample(trees, 30):
        out.append((rng.choice([site, None, "9_9"]), full, genus, rng.choice([family, None]), rng.choice([None, 0.3 + i / 1000])))
    return out


@pytest.mark.parametrize("level_by", ["name", "position"])
def test_equal_codes_of_different_taxa_do_not_mix(spark, monkeypatch, level_by):
    """With eight codes for all taxa, nearly every probe meets several keys."""
    rng = random.Random(level_by)
    trees, table = sample(rng)
    trees += [(1000, None, None, None, None, None), (1001, "1_1", None, "Quercus", None, None)]
    samples = some_samples(rng, trees)
    _, want = densities(spark, trees, samples, table, level_by=level_by)
    real = F.xxhash64
    monkeypatch.setattr(wd.F, "xxhash64", lambda *c: F.pmod(real(*c), F.lit(8)))
    for strategy in ("auto", "shuffle"):
        df, got = densities(spark, trees, samples, table, level_by=level_by, strategy=strategy)
        assert df.count() == len(trees) and got == want


def test_trees_meet_small_densities_without_moving(spark):
    trees, table = sample(random.Random(4))
    samples = some_samples(random.Random(4), trees)
    df, small = densities(spark, trees, samples, table)
    plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df, large = densities(spark, trees, samples, table, strategy="shuffle")
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert small == large
    assert "hashpartitioning(_at" in plan and "isnull" not in plan.split("Exchange")[1].split("\n")[0]


def test_no_samples_and_no_table(spark):
    trees, _ = sample(random.Random(5))
    for strategy in ("auto", "shuffle"):
        _, got = densities(spark, trees, [], [], strategy=strategy)
        assert set(got.values()) == {(0.48, "mean_mexico")}
        assert densities(spark, [], [], [], strategy=strategy)[1] == {}


def test_group_texts_read_their_rows_once(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice(["x", "y", None]), rng.choice([1, 2, 30, None])) for _ in range(5000)]
    rows.append(("lone", None, None))
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    df = spark.createDataFrame(rows, "k string, s string, n int").mapInPandas(count, "k string, s string, n int")
    out = grouped.group_concat_broadcast(df, "k", {"s": "texts", "n": "numbers"})
    got = [tuple(r) for r in out.collect()]
    assert read.value == len(rows) and "MapInPandas" not in out._jdf.queryExecution().toString()

    def text(k, place):
        return "/".join(sorted({str(r[place]) for r in rows if r[0] == k and r[place] is not None}))

    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted([(*r, text(r[0], 1), text(r[0], 2)) for r in rows], key=key)


@pytest.mark.parametrize("level_by", ["name", "position"])
def test_plots_meet_site_means_on_one_exchange(spark, monkeypatch, level_by):
    """Beyond the broadcast bound, taxa keep their table densities to themselves."""
    trees, table = sample(random.Random(6))
    trees += [(1000, None, None, None, None, None), (1001, "1_1", None, "Quercus", None, None)]
    samples = some_samples(random.Random(6), trees)
    _, want = densities(spark, trees, samples, table, level_by=level_by)
    tables = wd.density_tables(spark.createDataFrame(samples, SAMPLES), spark.createDataFrame(table, TABLE))
    codes = wd.coded_densities(spark.createDataFrame(trees, TREES), tables, strategy="shuffle", level_by=level_by)
    assert codes.taxa is not None and not codes.small
    assert codes.sited.filter(F.col("site_wd").isNull()).count() == 0
    seen = spark.createDataFrame(trees, TREES).select("source_code", *wd.SITE_LEVELS.values())
    plan = wd._add_site_grouped(seen, tables.site_levels).distinct()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    monkeypatch.setattr(wd, "fits_broadcast", lambda *a: False)
    codes = wd.coded_densities(spark.createDataFrame(trees, TREES), tables, level_by=level_by)
    assert codes.taxa is None
    assert densities(spark, trees, samples, table, level_by=level_by)[1] == want


def test_packed_codes_beyond_the_bound_are_not_broadcast(spark):
    rows = spark.range(20).select(F.col("id").cast("string").alias("full_species"))
    codes = wd.stage(wd.coded(rows.withColumn("v", F.lit(1)), {"full_species": "full_species"}, ["v"]), "codes")
    found = wd.probe(rows, codes, False)
    assert found.count() == 20 and found.filter("v = 1").count() == 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
