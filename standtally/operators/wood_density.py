"""Wood density per tree: site species, site genus, site family, global table, constant."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from standtally.functions import fixed
from standtally.functions.semantics import exact_mean, mean_of_units, nulls_last, paste, units
from standtally.operators.skew import hot_values, join_spread
from standtally.sources.staging import fits_broadcast, stage

SITE_LEVELS = {"species": "full_species", "genus": "genus", "family": "family"}


def site_taxon_density(samples: DataFrame, taxon: str) -> DataFrame:
    """Mean wood density of one taxon rank per site."""
    return samples.groupBy("source_code", taxon).agg(exact_mean("wd").alias("mean_wood_density"))


def site_density_levels(samples: DataFrame) -> DataFrame:
    """All three site means from one scan: ``source_code, level, taxon, wd``."""
    ranks = F.array(
        *[
            F.struct(F.lit(level).alias("level"), F.col(c).alias("taxon"))
            for level, c in SITE_LEVELS.items()
        ]
    )
    return (
        samples.select("source_code", "wd", F.inline(ranks))
        .groupBy("source_code", "level", "taxon")
        .agg(exact_mean("wd").alias("wd"))
    )


def packed_site_densities(samples: DataFrame) -> DataFrame:
    """The means of ``site_density_levels`` as one row per site, ``source_code, means``.

    ``means`` maps ``site_key`` of a level and taxon to its mean. Samples fold to sums per site and taxon on the map side, so a site with very many samples
    is spread over tasks. The sums then move once, by site, and give all three means there.
    """
    wd = units("wd", 9)
    sums = samples.groupBy("source_code", *SITE_LEVELS.values()).agg(
        F.sum(wd).alias("_sum"), F.count(wd).alias("_n")
    )
    ranks = F.array(
        *[
            F.struct(F.lit(level).alias("level"), F.col(c).alias("taxon"))
            for level, c in SITE_LEVELS.items()
        ]
    )
    means = (
        sums.repartition("source_code")
        .select("source_code", "_sum", "_n", F.inline(ranks))
        .groupBy("source_code", "level", "taxon")
        .agg(mean_of_units(F.sum("_sum"), F.sum("_n"), 9).alias("wd"))
    )
    entries = F.collect_list(F.struct(site_key(F.col("level"), F.col("taxon")), "wd"))
    return means.groupBy("source_code").agg(F.map_from_entries(entries).alias("means"))


def site_key(level: Column, taxon: Column) -> Column:
    """Level and taxon as one text; a missing taxon, which has a mean too, leaves the level."""
    return F.coalesce(F.concat(level, F.lit("="), taxon), level)


def unpacked_site_densities(sites: DataFrame) -> DataFrame:
    """Packed site means as ``site_density_levels`` gives them."""
    parts = F.split("_key", "=", 2)
    return sites.select("source_code", F.explode("means").alias("_key", "wd")).select(
        "source_code", F.get(parts, F.lit(0)).alias("level"), F.get(parts, F.lit(1)).alias("taxon"), "wd"
    )


def global_density_levels(global_wd: DataFrame, region: str | None = None) -> DataFrame:
    """Means of a density table as ``level, genus, taxon, wd``.

    A species mean is over rows, a genus mean over its species, a family mean over its
    genera; levels without any density are left out.
    """
    table = global_wd.filter(F.col("region") == region) if region else global_wd
    mean = exact_mean("wd").alias("wd")
    by_species = table.filter(F.col("genus").isNotNull()).groupBy("genus", "species").agg(mean)
    species = by_species.filter(F.col("species").isNotNull()).select(
        F.lit("species").alias("level"), "genus", F.col("species").alias("taxon"), "wd"
    )
    genus = by_species.groupBy("genus").agg(mean).select(
        F.lit("genus").alias("level"), "genus", F.lit(None).cast("string").alias("taxon"), "wd"
    )
    family = (
        table.filter(F.col("family").isNotNull())
        .groupBy("family", "genus", "species").agg(mean)
        .groupBy("family", "genus").agg(mean)
        .groupBy("family").agg(mean)
        .select(
            F.lit("family").alias("level"),
            F.lit(None).cast("string").alias("genus"),
            F.col("family").alias("taxon"),
            "wd",
        )
    )
    return species.unionByName(genus).unionByName(family).filter(F.col("wd").isNotNull())


def _add_global_joined(trees: DataFrame, levels: DataFrame, epithet: str) -> DataFrame:
    """Global means by one left join per level, for tables of any size."""

    def side(level: str) -> DataFrame:
        return levels.filter(F.col("level") == level).select(
            F.col("genus").alias("_genus"),
            F.col("taxon").alias("_taxon"),
            F.col("wd").alias(f"_wd_{level}"),
        )

    same_genus = F.col("genus") == F.col("_genus")
    return (
        trees.join(side("species"), same_genus & (F.col(epithet) == F.col("_taxon")), "left")
        .drop("_genus", "_taxon")
        .join(side("genus"), same_genus, "left")
        .drop("_genus", "_taxon")
        .join(side("family"), F.col("family") == F.col("_taxon"), "left")
        .drop("_genus", "_taxon")
    )


def add_own_density(trees: DataFrame, levels: DataFrame, epithet: str = "species") -> DataFrame:
    """Add ``own_wd`` and ``own_level`` of the finest level that covers a row's own taxon."""
    found = _add_global_joined(trees, levels, epithet)
    means = {level: F.col(f"_wd_{level}") for level in ("species", "genus", "family")}
    label = F
    for level, wd in means.items():
        label = label.when(wd.isNotNull(), F.lit(level))
    return found.withColumns({"own_wd": F.coalesce(*means.values()), "own_level": label}).drop(
        *[f"_wd_{level}" for level in means]
    )


def name_densities(trees: DataFrame, levels: DataFrame, epithet: str = "species") -> DataFrame:
    """The names of a census with their density, staged: ``name, global_wd, global_level``.

    A name is genus and epithet as text. Trees of one name may differ in family, which
    decides where neither species nor genus has a density; then the first family counts,
    a missing one last. Trees shrink to their distinct taxa by a map-side aggregate before
    anything is joined, so the dictionary costs one scan of three columns.
    """
    taxa = trees.select("genus", F.col(epithet).alias("epithet"), "family").distinct()
    taxon = F.struct("genus", "epithet", "family")
    first = F.min_by(taxon, F.struct(*nulls_last("genus", "epithet", "family"))).alias("_taxon")
    named = taxa.groupBy(paste("genus", "epithet").alias("name")).agg(first).select("name", "_taxon.*")
    return stage(
        add_own_density(named, levels, "epithet").select(
            "name", F.col("own_wd").alias("global_wd"), F.col("own_level").alias("global_level")
        ),
        "name-densities",
    )


def add_name_density(trees: DataFrame, names: DataFrame, small: bool) -> DataFrame:
    """Add ``global_wd`` and ``global_level`` of the census entry with a tree's full name.

    The entry may stem from other trees: an undetermined tree finds its genus' entry, and a
    tree whose full name is no entry of the census finds nothing.
    """
    return trees.join(
        F.broadcast(names) if small else names, F.col("full_species") == F.col("name"), "left"
    ).drop("name")


def global_wood_density(
    trees: DataFrame, global_wd: DataFrame, region: str | None = None, epithet: str = "species"
) -> DataFrame:
    """Look the trees of a census up in a density table of one region (default: all of it)."""
    levels = stage(global_density_levels(global_wd, region), "global-density")
    names = name_densities(trees, levels, epithet)
    return add_name_density(trees, names, fits_broadcast(names))


def _add_site_joined(trees: DataFrame, levels: DataFrame) -> DataFrame:
    """Site means by one left join per level, matching missing taxa to missing taxa."""
    out = trees
    for level, taxon in SITE_LEVELS.items():
        side = levels.filter(F.col("level") == level).select(
            F.col("source_code").alias("_site"),
            F.col("taxon").alias("_taxon"),
            F.col("wd").alias(f"_site_{level}"),
        )
        on = (F.col("source_code") == F.col("_site")) & F.col(taxon).eqNullSafe(F.col("_taxon"))
        out = out.join(side, on, "left").drop("_site", "_taxon")
    return out


def _add_site_grouped(taxa: DataFrame, levels: DataFrame) -> DataFrame:
    """As ``_add_site_joined`` for tables of any size, on one exchange by plot.

    Means and taxa of a plot meet in one task, where a window for each level carries the mean
    over to the taxa. A plot has at most the distinct taxa of the census and its samples.
    """
    means = levels.filter(F.col("source_code").isNotNull()).select(
        "source_code",
        *[F.when(F.col("level") == level, F.col("taxon")).alias(taxon) for level, taxon in SITE_LEVELS.items()],
        F.col("level").alias("_level"),
        F.col("wd").alias("_wd"),
    )
    both = taxa.unionByName(means, allowMissingColumns=True).repartition("source_code")
    for level, taxon in SITE_LEVELS.items():
        same = W.partitionBy("source_code", taxon)
        mean = F.max(F.when(F.col("_level") == level, F.col("_wd"))).over(same)
        both = both.withColumn(f"_site_{level}", mean)
    return both.filter(F.col("_level").isNull()).drop("_level", "_wd")


def meet_sites(trees: DataFrame, sites: DataFrame, hot: list[str]) -> DataFrame:
    """Add ``site_wd`` of a row's taxon from the packed means of its plot.

    Rows shuffle once, by plot, and stay so for what groups them by plot. Rows of the plots
    in ``hot`` meet the few rows of those plots by broadcast and are not shuffled.
    """
    found = join_spread(trees, sites, "source_code", hot, merge=True)
    means = [F.col("means")[site_key(F.lit(level), F.col(taxon))] for level, taxon in SITE_LEVELS.items()]
    return found.withColumn("site_wd", F.coalesce(*means)).drop("means")


@dataclass(frozen=True)
class DensityTables:
    """Staged density means, and whether they may be broadcast.

    ``sites`` holds the site means packed by site, if they were built so.
    """

    site_levels: DataFrame
    global_levels: DataFrame
    small: bool
    sites: DataFrame | None = None


def density_tables(
    samples: DataFrame, global_wd: DataFrame, region: str | None = None
) -> DensityTables:
    """Stage the site and global means and check their size."""
    sites = stage(packed_site_densities(samples), "site-density")
    site_levels = unpacked_site_densities(sites)
    global_levels = stage(global_density_levels(global_wd, region), "global-density")
    small = fits_broadcast(site_levels) and fits_broadcast(global_levels)
    return DensityTables(site_levels, global_levels, small, sites)


def coded(df: DataFrame, keys: dict[str, str], values: list[str]) -> DataFrame:
    """Values under a whole-number code of their keys: ``_code, _k_..., values``.

    ``keys`` names, for each column of the rows to be looked up, the column of ``df``.
    """
    return df.select(
        F.xxhash64(*keys.values()).alias("_code"),
        *[F.col(column).alias(f"_k_{key}") for key, column in keys.items()],
        *values,
    )


def probe(df: DataFrame, codes: DataFrame, small: bool) -> DataFrame:
    """Left join with a coded table by its code alone; a missing key part matches a missing one.

    Keys are compared as texts only where codes agree, so equal codes of different keys
    find nothing wrong. Packed files look small to the planner, so codes beyond the bound are
    kept from being broadcast.
    """
    keys = [c.removeprefix("_k_") for c in codes.columns if c.startswith("_k_")]
    on = F.col("_at") == F.col("_code")
    for key in keys:
        mine, other = F.col(key), F.col(f"_k_{key}")
        on = on & F.coalesce(mine == other, mine.isNull() & other.isNull())
    marked = df.withColumn("_at", F.xxhash64(*keys))
    return marked.join(F.broadcast(codes) if small else codes.hint("merge"), on, "left").drop(
        "_at", "_code", *[f"_k_{key}" for key in keys]
    )


@dataclass(frozen=True)
class CodedDensities:
    """A census' densities by coded taxon, staged.

    Two tables, ``sited`` by site and taxon and ``taxa`` by taxon alone. The second is
    broadcast, the first too if ``small``. With too many taxa for that there is one table,
    ``sited``, by plot and taxon; then ``taxa`` is missing. With few taxa but many sites
    ``sites`` takes the place of ``sited``: the packed means of each site, and ``hot`` lists
    the plots that hold a large share of the trees.
    """

    names: DataFrame
    sited: DataFrame | None
    taxa: DataFrame | None
    small: bool
    sites: DataFrame | None = None
    hot: tuple[str, ...] = ()


def census_taxa(trees: DataFrame, sites: DataFrame | None, epithet: str) -> DataFrame:
    """The distinct ``source_code, full_species, genus, epithet, family`` of a census, staged.

    With ``sites``, a small table of plot codes, other plots are not told apart, so the
    result is bounded by the taxa of those sites and of the census.
    """
    place = F.col("source_code")
    if sites is not None:
        side = F.broadcast(sites.select(F.col("source_code").alias("_site")).distinct())
        trees, place = trees.join(side, place == F.col("_site"), "left"), F.col("_site")
    return stage(
        trees.select(
            place.alias("source_code"), "full_species", "genus", F.col(epithet).alias("epithet"), "family"
        ).distinct(),
        "census-taxa",
    )


def coded_densities(
    trees: DataFrame,
    tables: DensityTables,
    epithet: str = "species",
    strategy: str = "auto",
    level_by: str = "name",
) -> CodedDensities:
    """Resolve the cascade once per distinct taxon of a census; one scan of the trees. Runs jobs.

    With many sites, taxa are first told apart by name alone. Where they are few, trees later
    meet their site's means by plot, and no table by plot and taxon is built.
    """
    small = tables.small and strategy == "auto"
    apart = strategy == "auto" and not small and tables.sites is not None
    if apart:
        nowhere = trees.withColumn("source_code", F.lit(None).cast("string"))
        seen = census_taxa(nowhere, None, epithet)
        apart = fits_broadcast(seen)
    if not apart:
        seen = census_taxa(trees, tables.site_levels if small else None, epithet)
    names = name_densities(seen, tables.global_levels, "epithet")
    by_site = {k: k for k in ("source_code", "full_species", "genus", "family")}
    by_taxon = {"full_species": "full_species"}
    if level_by == "position":
        by_taxon |= {"genus": "genus", epithet: "epithet", "family": "family"}

    def with_site(df: DataFrame) -> DataFrame:
        means = [f"_site_{level}" for level in SITE_LEVELS]
        found = (_add_site_joined if small else _add_site_grouped)(df, tables.site_levels)
        return found.withColumn("site_wd", F.coalesce(*means)).drop(*means)

    def with_global(df: DataFrame) -> DataFrame:
        found = add_name_density(df, names, False)
        if level_by == "position":
            found = add_own_density(found, tables.global_levels, "epithet").withColumn("global_level", F.col("own_level"))
        return found

    # Table densities depend on the taxon alone, so plots never meet them here.
    found = with_global(seen.select(*by_taxon.values()).distinct()).filter(F.col("global_wd").isNotNull())
    wanted = ["global_wd", "global_level"]
    taxa = stage(coded(found, by_taxon, wanted), "taxon-codes")
    few = fits_broadcast(taxa)
    if apart:
        hot = tuple(hot_values(trees, "source_code"))
        return CodedDensities(names, None, taxa, False, tables.sites, hot)
    if small:
        at_sites = seen.filter(F.col("source_code").isNotNull()).select(*by_site).distinct()
        sited = stage(
            coded(with_site(at_sites).filter(F.col("site_wd").isNotNull()), by_site, ["site_wd"]), "sited-codes"
        )
        if few and fits_broadcast(sited):
            return CodedDensities(names, sited, taxa, True)
        return coded_densities(trees, replace(tables, small=False), epithet, strategy, level_by)
    if few:
        # Means and rows of a plot are in one task, so distinct rows need no other exchange.
        at_plots = with_site(seen.select(*by_site)).filter(F.col("site_wd").isNotNull()).distinct()
        return CodedDensities(names, stage(coded(at_plots, by_site, ["site_wd"]), "sited-codes"), taxa, False)
    keys = by_site | by_taxon
    whole = with_global(with_site(seen.select(*keys.values())).distinct())
    return CodedDensities(names, stage(coded(whole, keys, ["site_wd", *wanted]), "plot-codes"), None, False)


def assign_wood_density(
    trees: DataFrame,
    tables: DensityTables,
    default: float = fixed.DEFAULT_WOOD_DENSITY,
    epithet: str = "species",
    strategy: str = "auto",
    level_by: str = "name",
    codes: CodedDensities | None = None,
) -> DataFrame:
    """Add ``wood_density`` (never missing) and ``level_wd`` to every tree.

    Densities of the table are found by full name, among the names of the census. Their
    level is that of the name, or with ``level_by="position"`` that of the tree's own taxon,
    which may be missing. ``codes`` is the result of ``coded_densities`` if there is one;
    else it is built here, which runs jobs.

    The cascade is resolved per distinct taxon, and trees probe the result by one whole
    number. Small tables are broadcast and trees never move. Beyond the bound, or with
    ``strategy="shuffle"``, trees shuffle once and table densities by taxon are still
    broadcast: with few taxa by plot, except for hot plots, else (and with
    ``strategy="shuffle"``) on the code of plot and taxon together, so that one hot plot
    spreads over its taxa.
    """
    if codes is None:
        codes = coded_densities(trees, tables, epithet, strategy, level_by)
    if codes.sites is not None:
        found = meet_sites(trees, codes.sites, list(codes.hot))
    else:
        found = probe(trees, codes.sited, codes.small)
    if codes.taxa is not None:
        found = probe(found, codes.taxa, True)
    return found.withColumns(
        {
            "wood_density": F.coalesce("site_wd", "global_wd", F.lit(default)),
            "level_wd": F.when(F.col("site_wd").isNotNull(), F.lit(fixed.LEVEL_SITE))
            .when(F.col("global_wd").isNull(), F.lit(fixed.LEVEL_DEFAULT))
            .otherwise(F.col("global_level")),
        }
    ).drop("site_wd", "global_wd", "global_level")


def wood_density_cascade(
    trees: DataFrame,
    samples: DataFrame,
    global_wd: DataFrame,
    default: float = fixed.DEFAULT_WOOD_DENSITY,
    region: str | None = None,
    epithet: str = "species",
    strategy: str = "auto",
    level_by: str = "name",
) -> DataFrame:
    """Density of every tree from site samples, a density table and a constant."""
    tables = density_tables(samples, global_wd, region)
    return assign_wood_density(trees, tables, default, epithet, strategy, level_by)
