"""All stages over one folder of test tables, each built once and staged where reused."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from standtally.operators.lookup import lookup_first
from standtally.operators.wood_density import CodedDensities, coded_densities
from standtally.plans import census, metadata, panel, refs, trees
from standtally.plans.refs import Refs
from standtally.plans.spec import CENSUSES
from standtally.sources.derived import DerivedInventory
from standtally.sources.staging import ingest, stage

REGION = "Mexico"


class Workspace:
    """Inputs and stages of one inventory; plot tables hand over as stored tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.inputs = DerivedInventory(spark, folder)
        self._trees: dict[int, DataFrame] = {}
        self._plots: dict[int, DataFrame] = {}
        self._codes: dict[tuple[int, str], CodedDensities] = {}

    def raw_trees(self, k: int) -> DataFrame:
        """The tree table of one census, ingested once."""
        if k not in self._trees:
            self._trees[k] = ingest(self.inputs.trees(k), f"trees-c{k}", self.inputs.tree_splits)
        return self._trees[k]

    @cached_property
    def states(self) -> DataFrame:
        return stage(refs.state_dictionary(self.raw_trees(3)), "states")

    @cached_property
    def refs(self) -> Refs:
        return refs.build_refs(
            self.raw_trees(3),
            self.inputs.wood_samples(),
            self.inputs.global_wood_density(),
            self.inputs.vegetation(),
            self.inputs.disturbance_names(),
            region=REGION,
            states=self.states,
        )

    def samples(self) -> DataFrame:
        return refs.site_samples(
            self.inputs.wood_samples(), refs.plot_site_map(self.raw_trees(3))
        )

    def key(self, df: DataFrame) -> DataFrame:
        """Add the plot key to a metadata table of the first two censuses."""
        return refs.with_plot_key(df, "conglomerado", "estado", self.states)

    def keyed(self, k: int, literal: bool = False) -> DataFrame:
        """Trees with key and species, before any density."""
        spec = CENSUSES[k]
        cleaned = trees.clean_sentinels(self.raw_trees(k), spec)
        named = refs.with_plot_key(cleaned, "plot", "state_name", self.states)
        return trees.parse_species(
            named, "scientific_name", spec.unknown_marks, hybrid=spec.hybrid, literal=literal
        )

    def codes(self, k: int, strategy: str = "auto") -> CodedDensities:
        """Densities by coded taxon of one census, built once."""
        if (k, strategy) not in self._codes:
            spec = CENSUSES[k]
            self._codes[k, strategy] = coded_densities(
                self.keyed(k), self.refs.densities, spec.epithet, strategy, spec.level_by
            )
        return self._codes[k, strategy]

    def all_trees(self, k: int) -> DataFrame:
        return trees.all_trees(self.raw_trees(k), CENSUSES[k], self.refs, codes=self.codes(k))

    def disturbed(self, k: int) -> DataFrame:
        return metadata.disturbance_full_join(
            self.key(self.inputs.registry(k)),
            self.key(self.inputs.impacts(k)),
            self.key(self.inputs.fires(k)),
        )

    def metadata(self, k: int) -> DataFrame:
        if k == 3:
            return metadata.plot_metadata_c3(self.inputs.registry_c3())
        return metadata.plot_metadata(
            self.key(self.inputs.registry(k)),
            self.key(self.inputs.impacts(k)),
            self.key(self.inputs.fires(k)),
            self.inputs.disturbance_names(),
        )

    def plot_table(self, k: int) -> DataFrame:
        args = (self.all_trees(k), self.metadata(k), self.refs, CENSUSES[k])
        if k == 3:
            return census.census_plot_table_c3(*args, self.inputs.disturbances_c3())
        return census.census_plot_table(*args)

    def stored_plots(self, k: int) -> DataFrame:
        """The plot table, written once and read back."""
        if k not in self._plots:
            self._plots[k] = stage(self.plot_table(k), f"plots-c{k}")
        return self._plots[k]

    def plots(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.stored_plots(1), self.stored_plots(2), self.stored_plots(3)

    def features(self, standardized: bool = False) -> DataFrame:
        return metadata.registry_features(
            self.inputs.plot_registry(), self.states, standardized
        )

    def long(self, align: str = "union") -> DataFrame:
        return panel.census_panel_long(*self.plots(), align=align)

    def panel(self, align: str = "union", one_row_per_census: bool = False) -> DataFrame:
        return panel.panel_with_change(
            *self.plots(),
            self.features(),
            self.inputs.vegetation(),
            align=align,
            one_row_per_census=one_row_per_census,
        )

    def causes(self, k: int) -> DataFrame:
        """Joined disturbance rows with cause text and its English name."""
        texts = self.disturbed(k).withColumn(
            "status_es", metadata.disturbance_cause("causa", "tipo_incendio")
        )
        return lookup_first(
            texts,
            "status_es",
            self.inputs.disturbance_names(),
            "impactos_ambientales",
            "distubances_en",
            out="status",
        )

    def measured(self) -> DataFrame:
        """Trees of the third census that have a diameter."""
        return self.all_trees(3).filter(F.col("diameter").isNotNull())
