"""Latin text and punctuation in ASCII, against examples and a plain version."""

import random
import re
import unicodedata

import pytest

from standtally.catalog import queries
from standtally.functions.fixed import ASCII_FORMS
from standtally.functions.text import ascii_form, fold_text, standardize_name

EXAMPLES = [
    ("Cañón – El’Alto", "canon - el'alto"),
    ("«Ñandú» “sí”…", '<<nandu>> "si"...'),
    ("ÆRØ, Straße, ŒUVRE, Þór", "aero, strasse, oeuvre, thor"),
    ("Łódź, Đà Nẵng, ħ, ƒ, ŋ, ı", "lodz, da nang, h, f, n, i"),
    ("ﬁn ﬄ ĳ ǆ ŉ", "fin ffl ij dz 'n"),
    ("½ ha × 2 ÷ 3 © ®", " 1/2 ha * 2 / 3 (c) (r)"),
    ("¿Qué? ¡No! 1ª 2º", "?que? !no! 1a 2o"),
    ("ＡＢ１\u3000ｃ", "ab1 c"),
    ("e\u0301 \u2009 \u00a0", "e    "),
    ("Ωμέγα 木 Д", "ωμέγα 木 д"),
    ("plain text_1", "plain text_1"),
    ("", ""),
    (None, None),
]


def plain(text):
    lowered = "".join(c for c in text.lower() if not 0x300 <= ord(c) < 0x370)
    return "".join((None if c.isascii() else ascii_form(c)) or c for c in lowered)


def test_examples(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EXAMPLES)], "id int, t string")
    got = df.select("id", fold_text("t").alias("f"), standardize_name("t").alias("s")).collect()
    for r in got:
        want = EXAMPLES[r.id][1]
        assert (r.f, r.s) == (want, None if want is None else want.replace(" ", "_")), r


def test_random_texts_match_a_plain_version(spark):
    rng = random.Random(4)
    pool = [chr(c) for c in range(0x20, 0x250) if chr(c).isprintable()] + list("–—‘’“”…‚„‹›ﬁﬂﬀẠạỹḑ中я\u2003") + list(ASCII_FORMS)
    rows = [(i, "".join(rng.choices(pool, k=rng.randrange(1, 40)))) for i in range(400)]
    got = spark.createDataFrame(rows, "id int, t string").select("id", fold_text("t").alias("f")).collect()
    for r in got:
        assert r.f == plain(rows[r.id][1]), rows[r.id]


@pytest.mark.parametrize("sign", [chr(c) for c in [*range(0xC0, 0x180)] if unicodedata.category(chr(c)) == "Ll"])
def test_every_common_latin_letter_has_an_ascii_form(sign):
    form = ascii_form(sign)
    assert form and form.isascii()


def test_rare_signs_stay_where_asked(spark):
    df = spark.createDataFrame([("Sierra «Ñ» ﬁn ﬃ ‼",)], "t string")
    assert df.select(fold_text("t", rare=False)).first()[0] == "sierra <<n>> fin ﬃ ‼"
    assert df.select(fold_text("t")).first()[0] == "sierra <<n>> fin ffi !!"


def test_third_census_trees_stay_compilable(spark):
    """Every generated method of the tree stage is below the size that the JVM compiles."""
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = queries()["tree_agb_c3"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan.explainString(mode))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    assert sizes and max(sizes) < 8000
