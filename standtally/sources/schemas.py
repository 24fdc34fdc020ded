"""Declared schemas of the inventory inputs, under their source column names."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and types of the input files, in file terms.
TREES_C1 = """
    Conglomerado INT, Estado STRING, Anio INT, Formato STRING, Tipo_veg_SV STRING,
    Sitio INT, Arbol INT, Familia_APG STRING, Condicion STRING, X DOUBLE, Y DOUBLE,
    Edad STRING, NombreCientifico_APG STRING, Diametro_normal DOUBLE, Altura_total DOUBLE
"""
TREES_C2 = TREES_C1 + ", Area_basal DOUBLE"
TREES_C3 = """
    Cve_Estado_C3 INT, Estado_C3 STRING, UPMID INT, IdConglomerado INT, Anio_C3 INT,
    ArboladoID_C3 BIGINT, DESECON4_C3 STRING, DESCRIP_S7_C3 STRING, FORM_S7_C3 STRING,
    X_C3 DOUBLE, Y_C3 DOUBLE, Sitio_C3 INT, NoIndividuo_C3 INT, NoRama_C3 INT,
    NombreCientifico_APG_C3 STRING, Familia_APG_C3 STRING, Genero_APG_C3 STRING,
    Especie_APG_C3 STRING, DiametroNormal_C3 DOUBLE, AlturaTotal_C3 DOUBLE,
    biomasa_kg_C3 STRING, carbono_kg_C3 STRING, Condicion_C3 STRING, MuertoPie_C3 STRING,
    Edad_C3 INT, AgenteDanio1_C3 STRING, AgenteDanio2_C3 STRING,
    AgenteDanio1_EST_C3 STRING, AgenteDanio2_EST_C3 STRING
"""
REGISTRY_C1 = """
    Conglomerado INT, Estado STRING, Formato STRING, Monitoreo STRING, Tenencia STRING,
    X DOUBLE, Y DOUBLE, Tipo_veg_SV STRING, Anio INT
"""
REGISTRY_C2 = """
    Conglomerado INT, Estado STRING, Formato STRING, Monitoreo STRING, Tenencia STRING,
    X DOUBLE, Y DOUBLE, Anio INT
"""
FIRES = "Conglomerado INT, Anio INT, Estado STRING, Anio_Incendio STRING, TipoIncendio STRING"
IMPACTS = "Conglomerado INT, Estado STRING, Causa STRING"
REGISTRY_C3 = """
    Cve_Estado_C3 INT, UPMID INT, IDConglomerado INT, X_C3 DOUBLE, Y_C3 DOUBLE,
    Estado_C3 STRING, UMAFOR_C3 STRING, DESCRIP_S7_C3 STRING, FAO_S7_C3 STRING,
    ECO_S7_C3 STRING, TIP_PROP_C3 STRING, TIP_NUC_C3 STRING, CVEECON1_C3 STRING,
    CVEECON2_C3 STRING, CVEECON3_C3 STRING, CVEECON4_C3 STRING, DESECON4_C3 STRING,
    ANP_CAT_MANEJO_C3 STRING, Tenencia_C3 STRING, FORM_S7_C3 STRING
"""
DISTURBANCES_C3 = "source_code STRING, disturbance_en STRING"
VEGETATION_CLASSES = (
    "source_veg_class_EN STRING, source_veg_class_std_ES STRING, climate STRING"
)
DISTURBANCE_NAMES = "Impactos_ambientales STRING, Distubances_en STRING"
WOOD_SAMPLES = """
    `UPMID SITE CODE` INT, STATE STRING, SPECIES STRING, GENUS STRING, FAMILY STRING,
    `BASIC WOOD DENSITY (g/cm3)` DOUBLE
"""
PLOT_REGISTRY = (
    "source_code STRING, forest_type STRING, State STRING, ecoregion_DESECON4 STRING"
)
GLOBAL_WOOD_DENSITY = (
    "family STRING, genus STRING, species STRING, region STRING, wd DOUBLE"
)

SCHEMAS = {
    "trees_c1": TREES_C1,
    "trees_c2": TREES_C2,
    "trees_c3": TREES_C3,
    "registry_c1": REGISTRY_C1,
    "registry_c2": REGISTRY_C2,
    "registry_c3": REGISTRY_C3,
    "fires": FIRES,
    "impacts": IMPACTS,
    "disturbances_c3": DISTURBANCES_C3,
    "vegetation_classes": VEGETATION_CLASSES,
    "disturbance_names": DISTURBANCE_NAMES,
    "wood_samples": WOOD_SAMPLES,
    "plot_registry": PLOT_REGISTRY,
    "global_wood_density": GLOBAL_WOOD_DENSITY,
}


def schema_of(table: str) -> T.StructType:
    """Declared schema of an input table."""
    return T.StructType.fromDDL(" ".join(SCHEMAS[table].split()))
