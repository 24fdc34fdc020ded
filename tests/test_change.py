"""Change between years with very many rows on one plot, ties and copies."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from standtally.operators.skew import join_unique
from standtally.plans import panel

COLUMNS = "source_code string, census_date int, census string, agb_mgha_1 double, land_ownership string"

# A step is from the row before in the declared order; rows of one year have none.
WINDOW_SQL = """SELECT source_code, census_date, census, agb_mgha_1, land_ownership,
    census_date - before AS year_diff,
    round(CAST(CAST(round(agb_mgha_1 * 1e3) AS BIGINT) - CAST(round(agb_before * 1e3) AS BIGINT) AS DOUBLE)
      / nullif((census_date - before) * 1e1, 0)) / 1e2 AS agb_change,
    census_date - start AS total_year_diff,
    (agb_mgha_1 - agb_start) / nullif(CAST(census_date - start AS DOUBLE), 0) AS agb_change_total
  FROM (SELECT *, lag(census_date) OVER w AS before, lag(agb_mgha_1) OVER w AS agb_before,
      first_value(census_date) OVER w AS start, first_value(agb_mgha_1) OVER w AS agb_start
    FROM rows WINDOW w AS (PARTITION BY source_code ORDER BY census_date NULLS LAST, land_ownership NULLS LAST,
      census NULLS LAST, agb_mgha_1 NULLS LAST))"""


def key(row):
    return tuple("" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v) for v in row)


def test_random_rows_against_a_window(spark):
    rng = random.Random(8)
    pick = rng.choice
    rows = [
        (pick(["a", "b", "c", None]), pick([2004, 2005, 2010, None]), pick(["c1", "c2"]), pick([None, 1.0, 2.125, 7.5]), pick(["x", None]))
        for _ in range(500)
    ]
    df = spark.createDataFrame(rows, COLUMNS)
    con = duckdb.connect()
    con.register("rows", df.toPandas().astype({"census_date": "Int64"}))
    want = con.execute(WINDOW_SQL).fetchall()
    got = [tuple(r) for r in panel.agb_change(df).collect()]
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_a_million_rows_on_one_plot(spark, tmp_path):
    n = 1_000_000
    hot = F.col("id") % 10 < 7
    spark.range(n).select(
        F.when(hot, "INFYS_NA_NA").otherwise(F.concat(F.lit("INFYS_"), (F.col("id") % 5000).cast("string"))).alias("source_code"),
        (2004 + F.xxhash64("id") % 3 * 5).cast("int").alias("census_date"),
        F.concat(F.lit("c"), F.col("id") % 3).alias("census"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 8).alias("agb_mgha_1"),
        F.when(F.col("id") % 2 == 0, "ejido").alias("land_ownership"),
    ).write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW rows AS SELECT * FROM '{tmp_path}/rows/*.parquet'")
    sums = "count(*), sum(year_diff), count(agb_change), sum(agb_change), sum(total_year_diff), sum(round(agb_change_total * 1e6))"
    want = con.execute(f"SELECT {sums} FROM ({WINDOW_SQL})").fetchone()
    changed = panel.agb_change(df)
    got = changed.selectExpr(*sums.replace(", ", "|").split("|")).first()
    assert [float(a) for a in got] == pytest.approx([float(a) for a in want], rel=1e-9)
    # The only window runs over aggregated years, not over rows.
    plan = changed._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [i for i, line in enumerate(plan) if "Window [" in line]
    assert windows and all(any("Aggregate" in line for line in plan[i : i + 4]) for i in windows)


def test_join_unique_with_hot_and_missing_keys(spark):
    many = spark.createDataFrame([("h" if i % 2 else None if i % 4 else f"k{i}", i) for i in range(4000)], "k string, i int")
    one = spark.createDataFrame([("h", 1), (None, 2), ("k8", 3), ("z", 4)], "k string, v int")
    got = {(r.i, r.k): r.v for r in join_unique(many, one, ["k"]).collect()}
    assert len(got) == 4000
    for (i, k), v in got.items():
        assert v == {"h": 1, None: 2, "k8": 3}.get(k)


def test_aligned_counts_without_pairs(spark):
    make = lambda keys: spark.createDataFrame([(k,) for k in keys], "source_code string")
    tables = make(["a", "a", "b", None]), make(["a", "a", "a", "c"]), make(["a", None])
    counts = {r.source_code: int(r.rows) for r in panel.aligned_counts(*tables).collect()}
    assert counts == {"a": 6, "b": 1, "c": 1, None: 2}


def test_join_without_hot_keys_reads_each_side_once(spark):
    many = spark.createDataFrame([(f"k{i % 2500}" if i % 2500 else None, i) for i in range(5000)], "k string, i int")
    one = spark.createDataFrame([("k8", 3), (None, 2), ("z", 4)], "k string, v int")
    joined = join_unique(many, one, ["k"])
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Union" not in plan
    want = {i: {8: 3, 0: 2}.get(i % 2500) for i in range(5000)}
    assert {r.i: r.v for r in joined.collect()} == want


def test_year_steps_carry_no_whole_rows(spark):
    rows = [("p", 2004, 1.0, 0), ("p", 2004, 2.0, 1), ("p", 2009, 4.0, 2), (None, None, None, 3)]
    variants = spark.createDataFrame(rows, "source_code string, census_date int, agb_mgha_1 double, _row bigint")
    steps = panel._year_steps(variants, F.struct(F.col("agb_mgha_1").alias("o0")))
    assert not any("struct" in kind for _, kind in steps.dtypes)
    got = {(r.source_code, r.census_date): (r._first_row, r._before, r._agb_before) for r in steps.collect()}
    assert got == {("p", 2004): (0, None, None), ("p", 2009): (2, 2004, 2.0), (None, None): (3, None, None)}
