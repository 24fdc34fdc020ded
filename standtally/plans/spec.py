"""What differs between the three censuses, as data."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CensusSpec:
    """Column mapping and rules of one census.

    ``columns`` maps our tree columns to the raw ones. ``age`` names the cleaning rule:
    zero and token, token only, or an upper limit. ``level_by`` tells whose level a density
    found by name carries: that of the ``name``'s entry, or that of the tree's own row
    (``position``).
    """

    number: int
    columns: dict[str, str]
    age: str
    unknown_marks: tuple[str, ...]
    hybrid: str | None
    epithet: str
    methods: tuple[str, ...]
    group_extra: tuple[str, ...]
    labels: tuple[str, ...]
    hectare_digits: int
    strict_age_mean: bool
    raw_height: bool
    all_subplots: bool
    state_from_code: bool
    carries: tuple[str, ...] = field(default=())
    level_by: str = "name"


_EARLY_COLUMNS = {
    "plot": "conglomerado",
    "state_name": "estado",
    "census_date": "anio",
    "vegetation": "tipo_veg_sv",
    "subplot": "sitio",
    "tag_number": "arbol",
    "family": "familia_apg",
    "condition": "condicion",
    "long": "x",
    "lat": "y",
    "age": "edad",
    "scientific_name": "nombre_cientifico_apg",
    "diameter": "diametro_normal",
    "raw_height": "altura_total",
}

_LATE_COLUMNS = {
    "plot": "id_conglomerado",
    "state_name": "estado_c3",
    "state_code": "cve_estado_c3",
    "census_date": "anio_c3",
    "vegetation": "descrip_s7_c3",
    "ecoregion": "desecon4_c3",
    "subplot": "sitio_c3",
    "tag_number": "arbolado_id_c3",
    "family": "familia_apg_c3",
    "epithet": "especie_apg_c3",
    "condition": "condicion_c3",
    "long": "x_c3",
    "lat": "y_c3",
    "age": "edad_c3",
    "scientific_name": "nombre_cientifico_apg_c3",
    "diameter": "diametro_normal_c3",
    "raw_height": "altura_total_c3",
    "reported_kg": "biomasa_kg_c3",
}

CENSUS1 = CensusSpec(
    number=1,
    columns=_EARLY_COLUMNS,
    age="zero",
    unknown_marks=("Aa",),
    hybrid=None,
    epithet="species",
    methods=("agb_tree_kg",),
    group_extra=("vegetation", "state_name", "std_state"),
    labels=("agb_eq1",),
    hectare_digits=2,
    strict_age_mean=False,
    raw_height=False,
    all_subplots=False,
    state_from_code=False,
)

CENSUS2 = CensusSpec(
    number=2,
    columns=_EARLY_COLUMNS,
    age="token",
    unknown_marks=("Aa",),
    hybrid=None,
    epithet="species",
    methods=("agb_tree_kg",),
    group_extra=("vegetation", "std_state"),
    labels=("agb_eq1",),
    hectare_digits=2,
    strict_age_mean=False,
    raw_height=False,
    all_subplots=False,
    state_from_code=False,
    carries=("agb_plot", "std_state"),
)

CENSUS3 = CensusSpec(
    number=3,
    columns=_LATE_COLUMNS,
    age="limit",
    unknown_marks=("Aa", "ZZ"),
    hybrid="x",
    epithet="epithet",
    methods=("agb_tree_kg", "agb2_tree_kg", "agb3_tree_kg"),
    group_extra=("collection_code", "lat", "long"),
    labels=("agb_eq1", "agb_eq2"),
    hectare_digits=3,
    strict_age_mean=True,
    raw_height=True,
    all_subplots=True,
    state_from_code=True,
    level_by="position",
)

CENSUSES = {1: CENSUS1, 2: CENSUS2, 3: CENSUS3}
