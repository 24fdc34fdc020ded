"""Fixed values that decide results. Stated plainly, in natural order."""

# Text printed for a missing value when pasting strings together.
MISSING_TEXT = "NA"

# Prefix of the public plot key.
KEY_PREFIX = "INFYS"

# ASCII for letters and signs whose form follows from no Unicode rule. Fixed values.
ASCII_FORMS = {
    "¡": "!",
    "©": "(c)",
    "«": "<<",
    "®": "(r)",
    "»": ">>",
    "¼": " 1/4",
    "½": " 1/2",
    "¾": " 3/4",
    "¿": "?",
    "×": "*",
    "ß": "ss",
    "æ": "ae",
    "ð": "d",
    "÷": "/",
    "þ": "th",
    "ı": "i",
    "ĸ": "q",
    "ŉ": "'n",
    "ŋ": "n",
    "œ": "oe",
    "ʹ": "'",
    "ʺ": '"',
    "ʻ": "'",
    "ʼ": "'",
    "ʽ": "'",
    "‖": "||",
    "‚": ",",
    "„": ",,",
    "′": "'",
    "″": '"',
    "‹": "<",
    "›": ">",
    "⁄": "/",
}

# Signs of several letters that names hardly hold.
RARE_SIGNS = "ŉǆǉǌǳ‖‥‼⁇⁈⁉ﬀﬃﬄﬅﬆ"

# Plot-level constants.
COUNTRY = "Mexico"
MINIMUM_DBH_PLOT = 75
STEM_LEVEL_AVAILABLE = 1
USAGE_POLICY = 0

# Labels of the biomass estimates.
LABEL_EQ1 = "EQ_016"
LABEL_EQ2 = "NI_eq"
LABEL_EQ3 = "EQ_005"

# Wood density for trees that no table covers, and the density level labels.
DEFAULT_WOOD_DENSITY = 0.48
LEVEL_SITE = "mexico_wd_db"
LEVEL_DEFAULT = "mean_mexico"

# Carbon share of biomass.
CARBON_FRACTION = 0.47

# Below-ground biomass: exp(intercept + slope * ln(carbon)), plus an offset in temperate climate.
BGB_INTERCEPT = -1.0587
BGB_SLOPE = 0.8836
BGB_TEMPERATE_OFFSET = 0.2840

# Sampled area in hectares by number of subplots; any other count has the full area.
AREA_BY_SUBPLOTS = {1: 0.04, 2: 0.08, 3: 0.12}
FULL_AREA = 0.16

# Limits beyond which a measurement is a sentinel.
MAX_HEIGHT_M = 100
MAX_HEIGHT_M_EQ3 = 500
MAX_DIAMETER = 1000
MAX_AGE_C3 = 9000

# Ownership, Spanish to English.
OWNERSHIP = [
    ("Propiedad Particular", "private"),
    ("Ejidal", "ejido"),
    ("Comunal", "community"),
    ("Propiedad Federal", "federal"),
]

# Third census: tenures that hand over to the nucleus type, the text for a blank
# tenure, and ordered first-match replacements.
OWNERSHIP_UNSTATED = ["No capturado", "No aplica"]
OWNERSHIP_BLANK = "unkown"
OWNERSHIP_REPLACEMENTS_C3 = [
    ("EJIDO", "ejido"),
    ("Ejido", "ejido"),
    ("Ejidal", "ejido"),
    ("Comunal", "community"),
    ("Comunidad", "community"),
    ("COMUNIDAD", "community"),
    ("Propiedad particular", "private"),
    ("Propiedad federal", "federal"),
]

# Extra rows of the state dictionary: code, name, standard name.
STATE_ALIASES = [
    (9, "Distrito Federal", "distrito_federal"),
    (9, "Ciudad de Mexico", "ciudad_de_mexico"),
    (22, "Queretaro de arteaga", "queretaro_de_arteaga"),
]
STATE_RENAMES = [("ciudad_de_mexico", "distrito_federal")]

# Disturbance texts.
FIRE_CAUSE = "Incendios"
FIRE_THIS_YEAR = "Año actual"
FIRE_EARLIER_YEARS = "Años anteriores"
SECONDARY_VEGETATION_ES = "vegetacion secundaria"
SECONDARY_VEGETATION = "secondary vegetation"

# Panel labels of the censuses.
CENSUS_LABELS = {"c1": "1", "c2": "2", "c3": "3"}

# Measures that the panel carries per census.
PANEL_MEASURES = [
    "agb_mgha_1",
    "agb2_mgha_1",
    "census_date",
    "source_vegetation_class",
    "source_vegetation_class_es",
    "height",
    "land_ownership",
    "plot_area_ha",
    "source_vegetation_status",
    "source_vegetation_status_es",
    "source_vegetation_status_year",
    "agb_eq1",
    "agb_eq2",
    "stand_age",
    "subplot_count",
    "umafor",
    "upmid",
    "ecoregion",
]
