"""Inventory inputs derived from the order-and-parts test tables.

Every row of the test tables takes part: line items are trees (split over the censuses
by ship year), parts are plots, registries and densities, orders are impacts and wood
samples, customers are fires, suppliers are disturbances. Columns carry the canonical
names that the readers produce.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from standtally.sources.staging import fits_broadcast, literal_table

NBSP = "\u00a0"

# Parts beyond this number are not sent whole to the driver and on to every executor.
PARTS_TO_SEND = 100_000

VEGETATION_TEXTS = [
    "Bosque de Pino",
    "Bosque de Encino",
    "Selva Alta",
    "Selva Baja con Vegetación Secundaria",
    "Matorral Xerófilo",
    "Manglar",
]
VEGETATION_CLASSES = [
    ("Pine forest", "bosque de pino", "Temperate"),
    ("Oak forest", "bosque de encino", "Temperate"),
    ("Tall evergreen forest", "selva alta", "Tropical"),
    ("Low forest, secondary", "selva baja con vegetacion secundaria", "Tropical"),
    ("Xeric shrubland", "matorral xerofilo", "Arid"),
]
DISTURBANCE_NAMES = [
    ("Incendios_Superficial", "surface fire"),
    ("Incendios_De copa", "crown fire"),
    ("Incendios_NA", "fire"),
    ("Plagas", "pests"),
    ("Plagas", "insects"),
    ("Tala", "logging"),
]
FIRST_YEAR = {1: 2004, 2: 2009, 3: 2015}
YEAR_SPREAD = {1: 4, 2: 6, 3: 6}
# First day that belongs to the census and first day after it.
SHIP_DAYS = {1: (None, "1997-01-01"), 2: ("1997-01-01", "1999-01-01"), 3: ("1999-01-01", None)}


def choose(index: Column, texts: list[str | None]) -> Column:
    """The text at a position."""
    return F.element_at(F.array(*[F.lit(t) for t in texts]), index.cast("int") + 1)


def state_index(plot: Column) -> Column:
    return F.pmod(plot, F.lit(25)).cast("int")


def state_code(plot: Column) -> Column:
    """Codes run from 1; one state has a code outside the known range."""
    index = state_index(plot)
    return F.when(index == 23, F.lit(33)).otherwise(index + 1)


def survey_year(plot: Column, census: int) -> Column:
    year = F.lit(FIRST_YEAR[census]) + F.pmod(plot, F.lit(YEAR_SPREAD[census]))
    return year.cast("int")


def vegetation_early(plot: Column) -> Column:
    """Class text; some plots write it with a no-break space."""
    text = choose(F.pmod(plot, F.lit(6)), VEGETATION_TEXTS)
    spaced = F.replace(text, F.lit("de Encino"), F.lit(f"de{NBSP}Encino"))
    return F.when(F.pmod(plot, F.lit(12)) == 1, spaced).otherwise(text)


def vegetation_late(plot: Column) -> Column:
    text = choose(F.pmod(plot, F.lit(6)), VEGETATION_TEXTS)
    return F.replace(text, F.lit("Bosque de"), F.lit(f"Bosque{NBSP}de"))


@dataclass(frozen=True)
class DerivedInventory:
    """The inventory inputs of one folder of test tables."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def sends_parts(self) -> bool:
        """Whether parts go whole to every executor."""
        return fits_broadcast(self.table("part").select("p_partkey", "p_name", "p_type", "p_size"), PARTS_TO_SEND)

    @property
    def tree_splits(self) -> int:
        """In how many tasks trees arrive: the splits of their file, or of a shuffle if they meet
        parts by one."""
        if self.sends_parts:
            return self.table("lineitem").rdd.getNumPartitions()
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _with_state(self, df: DataFrame, plot: Column, early: bool) -> DataFrame:
        """Add ``estado``: the nation of the plot; early censuses misspell one state."""
        nations = self.table("nation").select("n_nationkey", "n_name")
        accented = F.replace(F.col("n_name"), F.lit("NATION_"), F.lit("Nación "))
        name = (
            F.when(F.col("n_nationkey") == 24, F.lit("Entidad 24")).otherwise(accented)
            if early
            else accented
        )
        return (
            df.withColumn("_state", state_index(plot))
            .join(nations, F.col("_state") == F.col("n_nationkey"), "left")
            .withColumn("estado", name)
            .drop("_state", "n_nationkey", "n_name")
        )

    def _stems(self, census: int) -> DataFrame:
        """Line items of one census with the part that names their species."""
        first, after = (F.lit(d).cast("timestamp_ntz") for d in SHIP_DAYS[census])
        stems = self.table("lineitem")
        if census > 1:
            stems = stems.filter(F.col("l_shipdate") >= first)
        if census < 3:
            stems = stems.filter(F.col("l_shipdate") < after)
        return self._with_part(stems, F.col("l_orderkey") * 7 + F.col("l_suppkey"))

    def _with_part(self, df: DataFrame, number: Column) -> DataFrame:
        """Add the part that a whole number falls on, over the whole range of keys.

        Packed files look small to the planner, so the number of parts decides on the join.
        """
        taxa = self.table("part").select("p_partkey", "p_name", "p_type", "p_size")
        # One row, from the keys alone.
        keys = F.broadcast(taxa.agg((F.max("p_partkey") + 1).alias("_keys")))
        taxa = F.broadcast(taxa) if self.sends_parts else taxa.hint("shuffle_hash")
        return (
            df.withColumn("_number", number)
            .crossJoin(keys)
            .join(taxa, F.col("_number") % F.col("_keys") == F.col("p_partkey"), "left")
            .drop("_number", "_keys")
        )

    def trees(self, census: int) -> DataFrame:
        plot = F.col("l_partkey")
        line, tax = F.col("l_linenumber"), F.col("l_tax")
        words = F.split("p_name", " ")
        genus, epithet = words[0], words[1]
        kind = F.col("p_size") % 10
        name = (
            F.when(F.col("p_size") == 5, F.lit(None))
            .when(kind == 0, genus)
            .when(kind == 1, F.concat(F.lit("Aa "), epithet))
            .when(kind == 2, F.concat(F.lit("ZZ "), epithet))
            .when(kind == 3, F.concat(genus, F.lit(" x")))
            .when(kind == 4, F.concat(F.col("p_name"), F.lit(" var. b")))
            .otherwise(F.col("p_name"))
        )
        family = F.when(kind != 7, F.col("p_type"))
        subplot = F.when(
            ~((line == 7) & (F.col("l_returnflag") == "N")),
            (line % (plot % 4 + 1) + 1).cast("int"),
        )
        height = (
            F.when(line == 7, F.lit(999.0))
            .when((line == 4) & (tax == 0.01), F.lit(300.0))
            .when((line == 2) & (tax == 0.02), F.lit(None))
            .otherwise(F.col("l_discount") * 300)
        )
        unmeasured = (line == 6) & (tax == 0.0)
        year = survey_year(plot, census)
        stems = self._with_state(self._stems(census), plot, early=census < 3)
        if census < 3:
            age = (
                F.when(line == 3, F.lit("NULL"))
                .when(line == 5, F.lit("0"))
                .otherwise((line * 10).cast("string"))
            )
            columns = [
                plot.cast("int").alias("conglomerado"),
                F.col("estado"),
                year.alias("anio"),
                F.lit("F1").alias("formato"),
                vegetation_early(plot).alias("tipo_veg_sv"),
                subplot.alias("sitio"),
                F.col("l_orderkey").cast("int").alias("arbol"),
                family.alias("familia_apg"),
                F.col("l_linestatus").alias("condicion"),
                (-(F.lit(90.0) + plot * 0.001 + line * 0.0001)).alias("x"),
                (F.lit(15.0) + plot * 0.001 + line * 0.0001).alias("y"),
                age.alias("edad"),
                name.alias("nombre_cientifico_apg"),
                F.when(~unmeasured, F.col("l_quantity")).alias("diametro_normal"),
                height.alias("altura_total"),
            ]
            if census == 2:
                columns.append((F.col("l_quantity") / 10).alias("area_basal"))
            return stems.select(*columns)
        age3 = (
            F.when(line == 3, F.lit(9999))
            .when((line == 1) & (F.col("l_returnflag") == "R"), F.lit(None))
            .otherwise(line * 10)
        )
        diameter = F.when(
            ~unmeasured,
            F.when((line == 5) & (tax == 0.08), F.lit(9999993.0)).otherwise(F.col("l_quantity")),
        )
        shift = F.when((plot % 50 == 0) & (line > 4), F.lit(0.5)).otherwise(F.lit(0.0))
        reported = F.when(line == 1, F.lit("NULL")).otherwise(
            F.col("l_extendedprice").cast("string")
        )
        return stems.select(
            state_code(plot).alias("cve_estado_c3"),
            F.col("estado").alias("estado_c3"),
            (plot + 100000).cast("int").alias("upmid"),
            plot.cast("int").alias("id_conglomerado"),
            year.alias("anio_c3"),
            F.col("l_orderkey").alias("arbolado_id_c3"),
            F.concat(F.lit("Ecorregión "), F.col("p_type")).alias("desecon4_c3"),
            vegetation_late(plot).alias("descrip_s7_c3"),
            (-(F.lit(90.0) + plot * 0.001 + shift)).alias("x_c3"),
            (F.lit(15.0) + plot * 0.001 + shift).alias("y_c3"),
            subplot.alias("sitio_c3"),
            name.alias("nombre_cientifico_apg_c3"),
            family.alias("familia_apg_c3"),
            genus.alias("genero_apg_c3"),
            F.when(kind.isin(0, 3), F.lit("sp.")).otherwise(epithet).alias("especie_apg_c3"),
            diameter.alias("diametro_normal_c3"),
            height.alias("altura_total_c3"),
            reported.alias("biomasa_kg_c3"),
            F.col("l_linestatus").alias("condicion_c3"),
            age3.cast("int").alias("edad_c3"),
        )

    def registry(self, census: int) -> DataFrame:
        """Registry of the first two censuses: one row per part."""
        plot = F.col("p_partkey")
        owners = ["Propiedad Particular", "Ejidal", "Comunal", "Propiedad Federal", None]
        return self._with_state(self.table("part"), plot, early=True).select(
            plot.cast("int").alias("conglomerado"),
            "estado",
            choose(F.col("p_size") % 5, owners).alias("tenencia"),
            survey_year(plot, census).alias("anio"),
        )

    def impacts(self, census: int) -> DataFrame:
        """Impacts from orders; later orders belong to the second census."""
        early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
        rows = self.table("orders").filter(early if census == 1 else ~early)
        cause = (
            F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Incendios"))
            .when(F.col("o_orderpriority") == "2-HIGH", F.lit("Plagas"))
            .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("Tala"))
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("Pastoreo"))
        )
        plot = F.col("o_custkey")
        return self._with_state(rows, plot, early=True).select(
            plot.cast("int").alias("conglomerado"), "estado", cause.alias("causa")
        )

    def fires(self, census: int) -> DataFrame:
        """Fires from customers; several may fall on one plot, some on none known."""
        plot = F.col("c_custkey") - (F.col("c_nationkey") + census) % 3
        segment = F.col("c_mktsegment")
        when = (
            F.when(segment == "BUILDING", F.lit("Año actual"))
            .when(segment == "AUTOMOBILE", F.lit("Años anteriores"))
            .when(segment == "MACHINERY", F.lit("2003"))
            .when(segment == "FURNITURE", F.lit("1998"))
        )
        kinds = ["Superficial", "De copa", None]
        rows = self.table("customer").withColumn("_plot", plot)
        return self._with_state(rows, F.col("_plot"), early=True).select(
            F.col("_plot").cast("int").alias("conglomerado"),
            survey_year(F.col("_plot"), census).alias("anio"),
            "estado",
            when.alias("anio_incendio"),
            choose(F.col("c_nationkey") % 3, kinds).alias("tipo_incendio"),
        )

    def registry_c3(self) -> DataFrame:
        plot = F.col("p_partkey")
        nuclei = ["EJIDO", "COMUNIDAD", "Ejido", None]
        tenures = [
            "No capturado",
            "No aplica",
            "",
            "Ejidal",
            "Propiedad particular",
            "Propiedad federal",
            "Comunal",
            None,
            "Comunidad agraria",
        ]
        return self._with_state(self.table("part"), plot, early=False).select(
            state_code(plot).alias("cve_estado_c3"),
            (plot + 100000).cast("int").alias("upmid"),
            plot.cast("int").alias("id_conglomerado"),
            F.col("estado").alias("estado_c3"),
            F.concat(F.lit("UMAFOR "), F.col("p_brand")).alias("umafor_c3"),
            vegetation_late(plot).alias("descrip_s7_c3"),
            F.concat(F.lit("Ecorregión "), F.col("p_type")).alias("desecon4_c3"),
            choose(F.col("p_size") % 4, nuclei).alias("tip_nuc_c3"),
            choose(F.col("p_size") % 9, tenures).alias("tenencia_c3"),
        )

    def disturbances_c3(self) -> DataFrame:
        plot = F.col("s_suppkey")
        text = F.when(F.col("s_acctbal") < 3000, F.lit("fire")).when(
            F.col("s_acctbal") < 6000, F.lit("pests")
        )
        return self.table("supplier").select(
            F.concat_ws("_", F.lit("INFYS"), plot, state_code(plot)).alias("source_code"),
            text.alias("disturbance_en"),
        )

    def wood_samples(self) -> DataFrame:
        rows = self._with_part(self.table("orders"), F.col("o_orderkey"))
        kind = F.col("p_size") % 10
        genus = F.split("p_name", " ")[0]
        lost = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
        return rows.select(
            (F.col("o_custkey") + 100000).cast("int").alias("upmid_site_code"),
            F.when(kind == 0, F.concat(genus, F.lit(" sp.")))
            .otherwise(F.col("p_name"))
            .alias("species"),
            genus.alias("genus"),
            F.when(kind != 7, F.col("p_type")).alias("family"),
            F.when(~lost, (F.floor(F.col("o_totalprice") / 1000) + 300) / 1000).alias(
                "basic_wood_density_g_cm3"
            ),
        )

    def global_wood_density(self) -> DataFrame:
        words = F.split("p_name", " ")
        return self.table("part").select(
            F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("family"),
            F.when(words[0] != "hot", words[0]).alias("genus"),
            words[1].alias("species"),
            F.when(F.length("p_brand") == 7, F.lit("Mexico"))
            .otherwise(F.lit("World"))
            .alias("region"),
            (F.col("p_retailprice") / 2000).alias("wd"),
        )

    def plot_registry(self) -> DataFrame:
        """Registry over all censuses; each plot has two rows."""
        plot = F.col("p_partkey")
        rows = self._with_state(self.table("part"), plot, early=False).withColumn(
            "_copy", F.explode(F.array(F.lit(1), F.lit(2)))
        )
        return rows.select(
            F.concat_ws("_", F.lit("INFYS"), plot, state_code(plot)).alias("source_code"),
            vegetation_late(plot).alias("forest_type"),
            F.col("estado").alias("state"),
            F.concat(F.lit("Ecorregión "), F.col("p_type"), F.lit(" "), F.col("_copy")).alias(
                "ecoregion_desecon4"
            ),
        )

    def vegetation(self) -> DataFrame:
        return literal_table(
            self.spark,
            VEGETATION_CLASSES,
            "source_veg_class_en string, source_veg_class_std_es string, climate string",
        )

    def disturbance_names(self) -> DataFrame:
        return literal_table(
            self.spark, DISTURBANCE_NAMES, "impactos_ambientales string, distubances_en string"
        )
