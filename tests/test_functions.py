"""Golden rows of the column functions and null rules."""

import pytest
from pyspark.sql import functions as F

from standtally.functions import allometry as A
from standtally.functions import semantics as S
from standtally.functions import text
from standtally.operators import grouped
from standtally.plans import metadata, trees


def one(spark, *columns):
    return spark.range(1).select(*columns).collect()[0]


def lit(value, kind):
    return F.lit(value).cast(kind)


@pytest.mark.parametrize(
    "d, wd, h, kg", [(20.0, 0.6, 15.0, 199.05), (20.0, 0.48, 15.0, 160.10), (20.0, 0.6, None, None)]
)
def test_chave_016(spark, d, wd, h, kg):
    value = S.round_half_up(A.agb_chave_016(F.lit(d), F.lit(wd), lit(h, "double")), 2)
    assert one(spark, value)[0] == kg


def test_chave_005(spark):
    value = S.round_half_up(A.agb_chave_005(F.lit(20.0), F.lit(0.6), F.lit(15.0)), 2)
    assert one(spark, value)[0] == 201.24


@pytest.mark.parametrize(
    "value, d, h, kg",
    [
        ("120.5", 20.0, 15.0, 120.5),
        ("120.5", 20.0, None, None),
        ("120.5", 1500.0, None, None),
        ("NULL", 20.0, 15.0, None),
    ],
)
def test_reported(spark, value, d, h, kg):
    assert one(spark, A.agb_reported(F.lit(value), F.lit(d), lit(h, "double")))[0] == kg


@pytest.mark.parametrize("n, area", [(1, 0.04), (2, 0.08), (3, 0.12), (4, 0.16), (7, 0.16)])
def test_area(spark, n, area):
    assert one(spark, A.plot_area_ha(F.lit(n)))[0] == area


@pytest.mark.parametrize(
    "t, area, digits, expected",
    [(1.5, 0.12, 2, 12.5), (0.01, 0.08, 2, 0.13), (0.00005, 0.08, 3, 0.001), (0.0, 0.04, 2, 0.0)],
)
def test_per_hectare_rounds_ties_up(spark, t, area, digits, expected):
    assert one(spark, A.agb_per_hectare(F.lit(t), F.lit(area), digits))[0] == expected


@pytest.mark.parametrize(
    "code, label",
    [(1, "COL212"), (2, "COL214"), (9, "COL221"), (32, "COL244"), (33, None), (0, None), (None, None)],
)
def test_collection(spark, code, label):
    assert one(spark, A.collection_code(lit(code, "int")))[0] == label


@pytest.mark.parametrize(
    "carbon, climate, expected",
    [
        (47.0, "Tropical", 10.415451),
        (47.0, "Temperate", 13.836229),
        (47.0, "Arid", None),
        (47.0, None, None),
        (0.0, "Tropical", 0.0),
        (None, "Tropical", None),
    ],
)
def test_bgb(spark, carbon, climate, expected):
    value = F.round(A.bgb(lit(carbon, "double"), lit(climate, "string")), 6)
    assert one(spark, value)[0] == expected


def test_carbon(spark):
    assert one(spark, A.carbon(F.lit(100.0)))[0] == 47.0


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Nuevo León", "nuevo_leon"),
        ("MICHOACÁN DE OCAMPO", "michoacan_de_ocampo"),
        ("Straße ÆØ", "strasse_aeo"),
        ("Leo\u0301n", "leon"),
        ("", ""),
        (None, None),
    ],
)
def test_standardize(spark, raw, expected):
    assert one(spark, text.standardize_name(lit(raw, "string")))[0] == expected


def test_alias_and_nbsp(spark):
    row = one(
        spark,
        text.state_alias(text.standardize_name(F.lit("Ciudad de México"))),
        text.clean_nbsp(F.lit("Bosque\u00a0de Pino")),
    )
    assert list(row) == ["distrito_federal", "bosque de pino"]


def test_plot_key(spark):
    row = one(
        spark,
        text.plot_key(F.lit(123), F.lit(9)),
        text.plot_key(F.lit(123), lit(None, "int")),
        text.plot_key(F.lit(123), F.lit(9), prefix="INFYS"),
        text.public_key(F.lit("123_9")),
    )
    assert list(row) == ["123_9", "123_NA", "INFYS_123_9", "INFYS_123_9"]


@pytest.mark.parametrize(
    "name, options, expected",
    [
        ("Quercus laeta var. x", {}, ("Quercus", "laeta", "Quercus laeta")),
        ("Quercus", {}, ("Quercus", "sp.", "Quercus sp.")),
        ("Aa", {}, ("Aa", "sp.", "Indet sp. sp.")),
        ("Peñalia  rosa-alba", {}, ("Peñalia", "rosa", "Peñalia rosa")),
        (None, {}, (None, "sp.", "NA sp.")),
        ("Acacia texana", {"hybrid": "x"}, ("Acacia", "texana", "Acacia texana")),
        ("Acacia x", {"hybrid": "x"}, ("Acacia", "sp.", "Acacia sp.")),
        (
            "Acacia texana",
            {"hybrid": "x", "literal": True},
            ("Acacia", "tesp.ana", "Acacia tesp.ana"),
        ),
        ("ZZ top", {"unknown_marks": ("Aa", "ZZ")}, ("ZZ", "top", "Indet sp. top")),
    ],
)
def test_species(spark, name, options, expected):
    df = spark.createDataFrame([(name,)], "n string")
    row = text.parse_species(df, "n", **options).select("genus", "species", "full_species")
    assert tuple(row.collect()[0]) == expected


def test_sub_first_only_first(spark):
    row = one(spark, S.sub_first(F.lit("a.b.c"), ".", "$1"), S.sub_first(F.lit("x"), ".", "y"))
    assert list(row) == ["a$1b.c", "x"]


@pytest.mark.parametrize(
    "cause, kind, expected",
    [
        ("Incendios", "Superficial", "Incendios_Superficial"),
        ("Incendios", None, "Incendios_NA"),
        ("Plagas", "Superficial", "Plagas"),
        (None, "Superficial", None),
    ],
)
def test_cause(spark, cause, kind, expected):
    value = metadata.disturbance_cause(lit(cause, "string"), lit(kind, "string"))
    assert one(spark, value)[0] == expected


@pytest.mark.parametrize(
    "fire, expected",
    [("Año actual", 2005), ("Años anteriores", None), ("2003", 2003), (None, None)],
)
def test_fire_year(spark, fire, expected):
    assert one(spark, A.fire_status_year(lit(fire, "string"), F.lit(2005)))[0] == expected


@pytest.mark.parametrize(
    "tenure, nucleus, expected",
    [
        ("No aplica", "EJIDO", "ejido"),
        ("No capturado", None, None),
        ("", "EJIDO", "unkown"),
        ("Propiedad particular", None, "private"),
        ("Comunidad agraria", None, "community agraria"),
        (None, "EJIDO", None),
    ],
)
def test_ownership_c3(spark, tenure, nucleus, expected):
    value = metadata.ownership_normalize_c3(lit(tenure, "string"), lit(nucleus, "string"))
    assert one(spark, value)[0] == expected


def test_vegetation_status(spark):
    none = lit(None, "string")
    row = one(
        spark,
        text.vegetation_status(F.lit("fire"), F.lit("secondary vegetation")),
        text.vegetation_status(none, none),
        text.vegetation_status(F.lit("fire"), none),
    )
    assert list(row) == ["fire;secondary vegetation", "", "fire"]


@pytest.mark.parametrize(
    "age, rule, expected",
    [
        ("NULL", "zero", None),
        ("0", "zero", None),
        ("12", "zero", 12.0),
        ("0", "token", 0.0),
        ("9001", "limit", None),
        ("9000", "limit", 9000.0),
    ],
)
def test_ages(spark, age, rule, expected):
    assert one(spark, trees.clean_age(F.lit(age), rule))[0] == expected


def test_ifelse3(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "c boolean")
    got = df.select("c", S.ifelse3(F.col("c"), F.lit("y"), F.lit("n")).alias("v")).collect()
    assert {r.c: r.v for r in got} == {True: "y", False: "n", None: None}


def test_null_aware_aggregates(spark):
    df = spark.createDataFrame([(1, 10.0), (1, None), (2, 10.0), (None, 10.0)], "s int, a double")
    row = df.agg(
        S.count_distinct_na("s"),
        S.rounded_mean("a"),
        S.sum_fixed(F.when(F.col("s") > 5, F.col("a"))),
        S.rounded_mean(F.when(F.col("s") > 5, F.col("a"))),
    ).collect()[0]
    assert list(row) == [3, 10.0, 0, None]


def test_undefined_and_huge_measurements(spark):
    """Undefined values are missing, not 0; nothing stops at the range of a whole number."""
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(v,) for v in (nan, inf, -inf, 1e18, 2.5, None, 1e300)], "a double")
    got = [r[0] for r in df.select(S.round_half_up("a", 2)).collect()]
    assert got == [None, None, None, 1e18, 2.5, None, 1e300]
    row = df.agg(S.sum_fixed("a", 2), S.rounded_mean("a"), S.exact_mean("a")).first()
    assert int(row[0]) == 10**20 + 250 and row[1] == row[2] == pytest.approx(5e17)
    many = spark.range(30_000).select(F.lit(0.0673 * (0.5 * 9999993.0**2 * 20) ** 0.976).alias("kg"))
    assert float(many.agg(S.sum_fixed("kg", 2)).first()[0]) > 8e19
    negative = spark.range(1).select(S.round_half_up(A.agb_chave_016(F.lit(10.0), F.lit(0.5), F.lit(-1.0)), 2))
    assert negative.first()[0] is None


def test_distinct_concat(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "c string")
    row = df.agg(
        grouped.distinct_concat("c"), grouped.distinct_concat("c", keep_na=False)
    ).collect()[0]
    assert list(row) == ["NA;a;b", "a;b"]
