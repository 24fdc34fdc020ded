"""Folded metadata, exact fits, and CSV folders whose files differ."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from standtally.plans import census, compare, plots
from standtally.sources.schemas import schema_of
from standtally.sources.tables import read_inventory_csv


def test_fit_is_the_same_to_the_last_bit(spark):
    rng = random.Random(1)
    rows = [
        (round(x, 2), round(2.5 * x + rng.gauss(0, 30), 4) if rng.random() < 0.9 else None, round(abs(rng.gauss(9, 4)), 2))
        for x in (rng.uniform(0, 900) for _ in range(5000))
    ]
    rows += [(None, 1.0, 2.0), (float("nan"), 1.0, 1.0), (5.0, float("inf"), 3.0)]
    df = spark.createDataFrame(rows, "agb_tree_kg double, agb2_tree_kg double, agb3_tree_kg double")
    df = df.withColumn("agb2_tree_kg", F.abs("agb2_tree_kg"))
    fits = [compare.agb_method_fit(df.repartition(n, F.rand(n))).collect() for n in (2, 200)]
    assert fits[0] == fits[1]
    for row in fits[0]:
        i = {"agb2_tree_kg": 1, "agb3_tree_kg": 2}[row.agb_type]
        pairs = [(r[0], abs(r[i])) for r in rows if r[0] is not None and r[i] is not None and np.isfinite([r[0], r[i]]).all()]
        x, y = np.array(pairs).T
        slope, intercept = np.polyfit(x, y, 1)
        assert row.n == len(pairs)
        assert [row.slope, row.intercept, row.r2] == pytest.approx([slope, intercept, np.corrcoef(x, y)[0, 1] ** 2], rel=1e-8)


def test_fit_without_spread(spark):
    df = spark.createDataFrame([(2.0, 1.0, 3.0), (2.0, 5.0, 3.0)], "agb_tree_kg double, agb2_tree_kg double, agb3_tree_kg double")
    assert [(r.n, r.slope, r.r2) for r in compare.agb_method_fit(df).collect()] == [(2, None, None)] * 2
    assert [(r.n, r.slope) for r in compare.agb_method_fit(df.limit(0)).collect()] == [(0, None)] * 2
    flat = df.withColumn("agb_tree_kg", F.col("agb2_tree_kg"))
    assert [r.r2 for r in compare.agb_method_fit(flat).collect()] == [1.0, 1.0]


def test_folder_of_two_column_orders(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    schema = schema_of("trees_c1")
    names = schema.fieldNames()
    values = {f.name: "NA" for f in schema.fields}
    texts = [f.name for f in schema.fields if f.dataType.simpleString() == "string"][:2]
    numbers = [f.name for f in schema.fields if f.dataType.simpleString() in ("int", "double")][:1]

    def write(file, columns, rows):
        lines = [",".join(f'"{c}"' for c in columns)]
        lines += [",".join(str({**values, **row}.get(c, "extra, no".replace(",", ""))) for c in columns) for row in rows]
        (tmp_path / "a b" / file).write_text("\n".join(lines) + "\n", encoding="utf-8")

    write("1.csv", names, [{texts[0]: "p", texts[1]: "q", numbers[0]: 1}])
    write("2.csv", [*reversed(names), "Other"], [{texts[0]: "r", texts[1]: "s", numbers[0]: 2}])
    write("3.csv", names, [{texts[0]: "t", texts[1]: "u", numbers[0]: 3}])
    (tmp_path / "a b" / "4.csv").write_text("")
    got = read_inventory_csv(spark, str(tmp_path / "a b"), schema)
    assert got.columns == names
    assert {(r[texts[0]], r[texts[1]], int(r[numbers[0]])) for r in got.collect()} == {("p", "q", 1), ("r", "s", 2), ("t", "u", 3)}
    write("5.csv", names[1:], [{}])
    with pytest.raises(ValueError, match=names[0]):
        read_inventory_csv(spark, str(tmp_path / "a b"), schema)


def test_variants_count_copies(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, None)], "source_code string, v int")
    got = {tuple(r) for r in census.variants(df, "n").collect()}
    assert got == {("a", 1, 2), ("a", 2, 1), (None, None, 1)}


def test_rollup_of_the_third_census_reads_trees_once(spark):
    from standtally.catalog import workspace
    from standtally.plans.spec import CENSUSES

    w = workspace(spark, "/root/testdata/sf0.001")
    rollup = plots.plot_rollup(w.all_trees(3), CENSUSES[3])
    plan = rollup._jdf.queryExecution().optimizedPlan().toString()
    relations = [line for line in plan.splitlines() if "Relation [" in line and "arbolado_id_c3" in line]
    assert len(relations) == 1
