"""Densities by census-wide name, against a plain version."""

import random

import pytest

from standtally.operators import wood_density as wd

TREES = "id int, source_code string, full_species string, genus string, species string, family string"
TABLE = "region string, family string, genus string, species string, wd double"


def mean(values):
    values = [v for v in values if v is not None]
    return round(sum(values) / len(values), 9) if values else None


def own(table, genus, species, family):
    """Density and level of one taxon: over rows, over species, over genera."""
    by_species = {}
    for _, f, g, s, v in table:
        by_species.setdefault((g, s), []).append(v)
    if genus is not None and species is not None and mean(by_species.get((genus, species), [])) is not None:
        return mean(by_species[genus, species]), "species"
    of_genus = mean([mean(v) for (g, _), v in by_species.items() if g == genus and g is not None])
    if of_genus is not None:
        return of_genus, "genus"
    by_genus = {}
    for _, f, g, s, v in table:
        if f == family and f is not None:
            by_genus.setdefault(g, {}).setdefault(s, []).append(v)
    of_family = mean([mean([mean(v) for v in s.values()]) for s in by_genus.values()])
    return (of_family, "family") if of_family is not None else (None, None)


def plain(trees, table):
    last = lambda v: (v is None, v or "")
    first = {}
    for _, _, _, g, s, f in sorted(trees, key=lambda t: (last(t[3]), last(t[4]), last(t[5]))):
        first.setdefault(f"{'NA' if g is None else g} {'NA' if s is None else s}", (g, s, f))
    out = {}
    for i, _, full, g, s, f in trees:
        found, level = own(table, *first[full]) if full in first else (None, None)
        out[i] = (None if found is None else round(found, 6), level, own(table, g, s, f)[1])
    return out


def sample(rng):
    pick = lambda *v: rng.choice(v)
    trees = []
    for i in range(400):
        genus, species = pick("Quercus", "Pinus", "Abies", "Zea", None), pick("alba", "nigra", "sp.", "robur")
        full = pick(f"{genus or 'NA'} {species}", f"{genus or 'NA'} sp.", "Indet sp. alba")
        trees.append((i, pick("1_1", "2_1"), full, genus, species, pick("Fagaceae", "Pinaceae", "Poaceae", None)))
    table = [
        (pick("Mexico", "World"), pick("Fagaceae", "Pinaceae", None), pick("Quercus", "Pinus", "Larix", None),
         pick("alba", "nigra", None), pick(None, rng.randrange(300, 900) / 1000))
        for _ in range(40)
    ]
    return trees, table


@pytest.mark.parametrize("seed", range(3))
def test_global_density_goes_by_the_names_of_the_census(spark, seed):
    trees, table = sample(random.Random(seed))
    want = plain(trees, [r for r in table if r[0] == "Mexico"])
    df = spark.createDataFrame(trees, TREES)
    got = wd.global_wood_density(df, spark.createDataFrame(table, TABLE), region="Mexico").collect()
    assert len(got) == len(trees)
    for r in got:
        found = None if r.global_wd is None else round(r.global_wd, 6)
        assert (found, r.global_level) == want[r.id][:2], r


@pytest.mark.parametrize("strategy", ["auto", "shuffle"])
@pytest.mark.parametrize("level_by", ["name", "position"])
def test_level_is_that_of_the_name_or_of_the_row(spark, strategy, level_by):
    trees, table = sample(random.Random(9))
    want = plain(trees, table)
    samples = spark.createDataFrame([("1_1", "Zea alba", "Zea", "Poaceae", 0.7)], "source_code string, full_species string, genus string, family string, wd double")
    got = wd.wood_density_cascade(
        spark.createDataFrame(trees, TREES), samples, spark.createDataFrame(table, TABLE), strategy=strategy, level_by=level_by
    ).collect()
    for r in got:
        found, level, position = want[r.id]
        if r.level_wd == "mexico_wd_db":
            assert r.source_code == "1_1" and ("Zea" in (r.full_species, r.genus) or r.family == "Poaceae" or r.genus == "Zea")
        elif found is None:
            assert (r.wood_density, r.level_wd) == (0.48, "mean_mexico")
        else:
            assert round(r.wood_density, 6) == found and r.level_wd == (position if level_by == "position" else level)


def test_an_undetermined_tree_finds_its_genus(spark):
    trees = [(1, "1_1", "Quercus sp.", "Quercus", "sp.", None), (2, "1_1", "Quercus sp.", "Quercus", "alba", None)]
    table = [("Mexico", None, "Quercus", "alba", 0.8), ("Mexico", None, "Quercus", "nigra", 0.6)]
    got = wd.global_wood_density(spark.createDataFrame(trees, TREES), spark.createDataFrame(table, TABLE)).collect()
    assert {(r.id, round(r.global_wd, 6), r.global_level) for r in got} == {(1, 0.7, "genus"), (2, 0.7, "genus")}
