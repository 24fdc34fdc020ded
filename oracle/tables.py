"""Shared table expressions: the inventory inputs and every stage built on them."""

from __future__ import annotations

import re

NB = "chr(160)"


# Signs and letters without an accent to strip, and what stands for them.
_ONE = {"‐‑‒–—―": "-", "‘’‛′ʼ": "'", "“”‟″": '"', "ðđ": "d", "ø": "o", "ł": "l", "ħ": "h", "ı": "i", "ŋ": "n",
        "ŧ": "t", "ƒ": "f", "ſ": "s", "×": "*", "÷⁄": "/", "¿": "?", "¡": "!", "ª": "a", "º": "o", "‚": ",", "‹": "<", "›": ">"}
_SEVERAL = [("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ĳ", "ij"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("«", "<<"),
            ("»", ">>"), ("…", "..."), ("„", ",,"), ("©", "(c)"), ("®", "(r)"), ("¼", " 1/4"), ("½", " 1/2"), ("¾", " 3/4")]


def fold(x: str) -> str:
    """Lower case in ASCII, as far as the two lists go."""
    signs = "".join(_ONE)
    plain = "".join(form * len(group) for group, form in _ONE.items()).replace("'", "''")
    s = f"translate(lower(strip_accents(replace({x}, {NB}, ' '))), '{signs}', '{plain}')"
    for sign, form in _SEVERAL:
        s = f"replace({s}, '{sign}', '{form}')"
    return s


def std(x: str) -> str:
    return f"replace({fold(x)}, ' ', '_')"


def mean9(x: str) -> str:
    return f"CAST(sum(CAST(round({x} * 1e9) AS BIGINT)) AS DOUBLE) / (count({x}) * 1e9)"


def mean2(x: str) -> str:
    """Mean to two decimals over values kept to four."""
    return (
        f"round(CAST(sum(CAST(round({x} * 1e4) AS BIGINT)) AS DOUBLE)"
        f" / nullif(count({x}) * 1e2, 0)) / 1e2"
    )


def area(n: str) -> str:
    return (
        f"CASE {n} WHEN 1 THEN 0.04e0 WHEN 2 THEN 0.08e0 WHEN 3 THEN 0.12e0 ELSE 0.16e0 END"
    )


def collection(code: str) -> str:
    return (
        f"CASE WHEN {code} = 1 THEN 'COL212' WHEN {code} BETWEEN 2 AND 32"
        f" THEN 'COL' || CAST(213 + {code} - 1 AS VARCHAR) END"
    )


VEG_EARLY = """CASE plot % 6 WHEN 0 THEN 'Bosque de Pino'
    WHEN 1 THEN CASE WHEN plot % 12 = 1 THEN 'Bosque de' || chr(160) || 'Encino' ELSE 'Bosque de Encino' END
    WHEN 2 THEN 'Selva Alta' WHEN 3 THEN 'Selva Baja con Vegetación Secundaria'
    WHEN 4 THEN 'Matorral Xerófilo' ELSE 'Manglar' END"""
VEG_LATE = """CASE plot % 6 WHEN 0 THEN 'Bosque' || chr(160) || 'de Pino'
    WHEN 1 THEN 'Bosque' || chr(160) || 'de Encino'
    WHEN 2 THEN 'Selva Alta' WHEN 3 THEN 'Selva Baja con Vegetación Secundaria'
    WHEN 4 THEN 'Matorral Xerófilo' ELSE 'Manglar' END"""
YEAR_OF = {
    1: "CAST(2004 + ((plot % 4) + 4) % 4 AS INT)",
    2: "CAST(2009 + ((plot % 6) + 6) % 6 AS INT)",
    3: "CAST(2015 + ((plot % 6) + 6) % 6 AS INT)",
}
STATE_OF = "CAST(((plot % 25) + 25) % 25 AS INT)"

T: dict[str, str] = {}

T["nat"] = """SELECT CAST(n_nationkey AS INT) AS nk, replace(n_name, 'NATION_', 'Nación ') AS late_name,
    CASE WHEN n_nationkey = 24 THEN 'Entidad 24' ELSE replace(n_name, 'NATION_', 'Nación ') END AS early_name,
    CASE WHEN n_nationkey = 23 THEN 33 ELSE CAST(n_nationkey AS INT) + 1 END AS code FROM nation"""

T["stems"] = f"""SELECT *, {STATE_OF} AS nk FROM (
    SELECT l_partkey AS plot, l_orderkey, l_suppkey, l_linenumber AS line, l_quantity, l_extendedprice,
      l_discount, l_tax, l_returnflag, l_linestatus,
      CASE WHEN l_shipdate < TIMESTAMP '1997-01-01' THEN 1
           WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN 2 ELSE 3 END AS census,
      p_name, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2,
      p_type, p_size, p_size % 10 AS kind
    FROM lineitem LEFT JOIN part
      ON p_partkey = (l_orderkey * 7 + l_suppkey) % (SELECT max(p_partkey) + 1 FROM part))"""

T["trees"] = f"""SELECT census, plot, nk, code, CASE WHEN census < 3 THEN early_name ELSE late_name END AS state_name,
    CASE census WHEN 1 THEN {YEAR_OF[1]} WHEN 2 THEN {YEAR_OF[2]} ELSE {YEAR_OF[3]} END AS yr,
    CASE WHEN census < 3 THEN {VEG_EARLY} ELSE {VEG_LATE} END AS veg,
    CASE WHEN NOT (line = 7 AND l_returnflag = 'N') THEN CAST(line % (plot % 4 + 1) + 1 AS INT) END AS subplot,
    l_orderkey AS tag, CASE WHEN kind <> 7 THEN p_type END AS family, l_linestatus AS cond,
    CASE WHEN census < 3 THEN -(90e0 + plot * 0.001e0 + line * 0.0001e0)
         ELSE -(90e0 + plot * 0.001e0 + CASE WHEN plot % 50 = 0 AND line > 4 THEN 0.5e0 ELSE 0e0 END) END AS long,
    CASE WHEN census < 3 THEN 15e0 + plot * 0.001e0 + line * 0.0001e0
         ELSE 15e0 + plot * 0.001e0 + CASE WHEN plot % 50 = 0 AND line > 4 THEN 0.5e0 ELSE 0e0 END END AS lat,
    CASE line WHEN 3 THEN 'NULL' WHEN 5 THEN '0' ELSE CAST(line * 10 AS VARCHAR) END AS age_text,
    CASE WHEN line = 3 THEN 9999 WHEN line = 1 AND l_returnflag = 'R' THEN NULL ELSE line * 10 END AS age_number,
    CASE WHEN p_size = 5 THEN NULL WHEN kind = 0 THEN w1 WHEN kind = 1 THEN 'Aa ' || w2
         WHEN kind = 2 THEN 'ZZ ' || w2 WHEN kind = 3 THEN w1 || ' x'
         WHEN kind = 4 THEN p_name || ' var. b' ELSE p_name END AS sci,
    w1 AS apg_genus, CASE WHEN kind IN (0, 3) THEN 'sp.' ELSE w2 END AS apg_epithet,
    CASE WHEN line = 6 AND l_tax = 0e0 THEN NULL
         WHEN census = 3 AND line = 5 AND l_tax = 0.08e0 THEN 9999993e0 ELSE l_quantity END AS diameter,
    CASE WHEN line = 7 THEN 999e0 WHEN line = 4 AND l_tax = 0.01e0 THEN 300e0
         WHEN line = 2 AND l_tax = 0.02e0 THEN NULL ELSE l_discount * 300 END AS raw_height,
    CASE WHEN line = 1 THEN 'NULL' ELSE CAST(l_extendedprice AS VARCHAR) END AS reported,
    p_type, l_suppkey, line, l_quantity
    FROM stems JOIN nat USING (nk)"""

T["cleaned"] = """SELECT *,
    CASE WHEN raw_height IS NULL OR raw_height > 100 THEN NULL ELSE raw_height END AS height,
    CASE WHEN census = 1 THEN nullif(TRY_CAST(age_text AS DOUBLE), 0)
         WHEN census = 2 THEN TRY_CAST(age_text AS DOUBLE)
         WHEN age_number > 9000 THEN NULL ELSE CAST(age_number AS DOUBLE) END AS stand_age
    FROM trees"""

T["states"] = f"""SELECT DISTINCT code, state_name AS name,
      replace({std('state_name')}, 'ciudad_de_mexico', 'distrito_federal') AS std_name
      FROM trees WHERE census = 3 AND code IS NOT NULL
    UNION ALL SELECT * FROM (VALUES (9, 'Distrito Federal', 'distrito_federal'),
      (9, 'Ciudad de Mexico', 'ciudad_de_mexico'), (22, 'Queretaro de arteaga', 'queretaro_de_arteaga'))
      AS v(code, name, std_name)"""

T["state_of"] = "SELECT std_name, min(code) AS state_id FROM states GROUP BY std_name"

T["keyed"] = f"""SELECT c.*, {std('state_name')} AS std_state, s.state_id,
      CAST(plot AS VARCHAR) || '_' || coalesce(CAST(s.state_id AS VARCHAR), 'NA') AS source_code
    FROM cleaned c LEFT JOIN state_of s ON s.std_name = {std('c.state_name')}"""

T["named"] = r"""SELECT *, CASE WHEN census = 3 THEN regexp_replace(full1, 'ZZ', 'Indet sp.') ELSE full1 END AS full_species
    FROM (SELECT *, regexp_replace(coalesce(genus, 'NA') || ' ' || species, 'Aa', 'Indet sp.') AS full1
      FROM (SELECT *, words[1] AS genus,
          CASE WHEN words[2] IS NULL THEN 'sp.' WHEN census = 3 AND words[2] = 'x' THEN 'sp.' ELSE words[2] END AS species
        FROM (SELECT *, string_split_regex(sci, '[^\p{L}\p{M}\p{Nd}]+') AS words FROM keyed)))"""

T["wood"] = """SELECT CAST(100000 + o_custkey AS INT) AS upmid,
      CASE WHEN p_size % 10 = 0 THEN split_part(p_name, ' ', 1) || ' sp.' ELSE p_name END AS full_species,
      split_part(p_name, ' ', 1) AS genus, CASE WHEN p_size % 10 <> 7 THEN p_type END AS family,
      CASE WHEN NOT (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')
           THEN (floor(o_totalprice / 1000) + 300) / 1000 END AS wd
    FROM orders LEFT JOIN part ON p_partkey = o_orderkey % (SELECT max(p_partkey) + 1 FROM part)"""

T["sites"] = """SELECT DISTINCT CAST(plot + 100000 AS INT) AS upmid, plot, code,
      CAST(plot AS VARCHAR) || '_' || coalesce(CAST(code AS VARCHAR), 'NA') AS source_code
    FROM trees WHERE census = 3"""

T["samples"] = """SELECT m.source_code, w.full_species, w.genus, w.family, w.wd FROM wood w
    JOIN (SELECT upmid, source_code, row_number() OVER (PARTITION BY upmid ORDER BY plot, code) AS rn FROM sites) m
      ON m.upmid = w.upmid AND m.rn = 1"""

for _t in ("full_species", "genus", "family"):
    T[f"site_{_t}"] = (
        f"SELECT source_code, {_t}, {mean9('wd')} AS mean_wood_density"
        f" FROM samples GROUP BY source_code, {_t}"
    )

T["density_table"] = """SELECT CASE WHEN p_type <> 'PROMO' THEN p_type END AS family,
      CASE WHEN split_part(p_name, ' ', 1) <> 'hot' THEN split_part(p_name, ' ', 1) END AS genus,
      split_part(p_name, ' ', 2) AS species, p_retailprice / 2000 AS wd
    FROM part WHERE length(p_brand) = 7"""
T["g_species"] = f"""SELECT genus, species, {mean9('wd')} AS wd FROM density_table
    WHERE genus IS NOT NULL GROUP BY genus, species"""
T["g_genus"] = f"SELECT genus, {mean9('wd')} AS wd FROM g_species GROUP BY genus"
T["g_family"] = f"""SELECT family, {mean9('wd')} AS wd FROM (
      SELECT family, genus, {mean9('wd')} AS wd FROM (
        SELECT family, genus, species, {mean9('wd')} AS wd FROM density_table
        WHERE family IS NOT NULL GROUP BY family, genus, species)
      GROUP BY family, genus) GROUP BY family"""

T["taxa"] = """SELECT DISTINCT census, genus, CASE WHEN census = 3 THEN apg_epithet ELSE species END AS epithet,
      family FROM named"""
T["taxon_density"] = """SELECT t.*, coalesce(t.genus, 'NA') || ' ' || coalesce(t.epithet, 'NA') AS name,
      coalesce(s.wd, g.wd, f.wd) AS wd,
      CASE WHEN s.wd IS NOT NULL THEN 'species' WHEN g.wd IS NOT NULL THEN 'genus'
           WHEN f.wd IS NOT NULL THEN 'family' END AS level
    FROM taxa t LEFT JOIN g_species s ON s.genus = t.genus AND s.species = t.epithet
    LEFT JOIN g_genus g ON g.genus = t.genus LEFT JOIN g_family f ON f.family = t.family"""
# The source looks a full name up among the names of all rows of the census: the first counts.
T["name_density"] = """SELECT census, name, wd, level FROM taxon_density QUALIFY row_number() OVER (
      PARTITION BY census, name ORDER BY genus NULLS LAST, epithet NULLS LAST, family NULLS LAST) = 1"""
T["global_found"] = """SELECT n.*, m.wd AS global_wd, m.level AS global_level, o.level AS own_level
    FROM named n LEFT JOIN name_density m ON m.census = n.census AND m.name = n.full_species
    JOIN taxon_density o ON o.census = n.census AND o.genus IS NOT DISTINCT FROM n.genus
      AND o.epithet IS NOT DISTINCT FROM CASE WHEN n.census = 3 THEN n.apg_epithet ELSE n.species END
      AND o.family IS NOT DISTINCT FROM n.family"""

T["dense"] = """SELECT n.*,
      coalesce(a.mean_wood_density, b.mean_wood_density, c.mean_wood_density, global_wd, 0.48e0) AS wood_density,
      CASE WHEN coalesce(a.mean_wood_density, b.mean_wood_density, c.mean_wood_density) IS NOT NULL
           THEN 'mexico_wd_db' WHEN global_wd IS NULL THEN 'mean_mexico'
           WHEN n.census = 3 THEN own_level ELSE global_level END AS level_wd
    FROM global_found n
    LEFT JOIN site_full_species a ON a.source_code = n.source_code AND a.full_species IS NOT DISTINCT FROM n.full_species
    LEFT JOIN site_genus b ON b.source_code = n.source_code AND b.genus IS NOT DISTINCT FROM n.genus
    LEFT JOIN site_family c ON c.source_code = n.source_code AND c.family IS NOT DISTINCT FROM n.family"""

T["agb"] = f"""SELECT *,
      CASE WHEN census < 3 THEN floor(0.0673e0 * pow(wood_density * (diameter * diameter) * height, 0.976e0) * 100 + 0.5e0) / 100
           WHEN diameter > 1000 OR raw_height > 100 THEN NULL
           WHEN diameter IS NULL OR raw_height IS NULL THEN NULL
           ELSE floor(0.0673e0 * pow(wood_density * (diameter * diameter) * raw_height, 0.976e0) * 100 + 0.5e0) / 100 END AS agb_tree_kg,
      CASE WHEN census = 3 AND diameter <= 1000 AND raw_height <= 100
           THEN TRY_CAST(reported AS DOUBLE) END AS agb2_tree_kg,
      CASE WHEN census = 3 AND diameter <= 1000 AND raw_height <= 500
           THEN floor(0.0559e0 * (wood_density * (diameter * diameter) * raw_height) * 100 + 0.5e0) / 100 END AS agb3_tree_kg,
      {collection('code')} AS collection_code
    FROM dense"""

for _k, _extra in ((1, ["veg", "state_name", "std_state"]), (2, ["veg", "std_state"])):
    T[f"rollup{_k}"] = f"""SELECT *, round(100 * round(agb_plot * 100) / round(plot_area_ha * 100)) / 100 AS agb_mgha_1
    FROM (SELECT *, {area('subplot_count')} AS plot_area_ha FROM (
      SELECT source_code, yr AS census_date, {', '.join(_extra)},
        count(DISTINCT subplot) + max(CASE WHEN subplot IS NULL THEN 1 ELSE 0 END) AS subplot_count,
        round(CAST(coalesce(sum(CAST(round(agb_tree_kg * 100) AS BIGINT)), 0) AS DOUBLE) / 1000) / 100 AS agb_plot,
        {mean2('stand_age')} AS stand_age, {mean2('height')} AS height
      FROM agb WHERE census = {_k} GROUP BY source_code, yr, {', '.join(_extra)}))"""

T["subplots3"] = """SELECT source_code, count(DISTINCT subplot)
      + max(CASE WHEN subplot IS NULL THEN 1 ELSE 0 END) AS subplot_count
    FROM keyed WHERE census = 3 GROUP BY source_code"""
T["rollup3"] = f"""SELECT source_code, collection_code, lat, long, census_date, subplot_count,
      k100 / 1e5 AS agb_plot, CAST(kg2 AS DOUBLE) / 1e3 AS agb2_plot, stand_age, height, plot_area_ha,
      round(k100 / round(plot_area_ha * 100)) / 1000 AS agb_mgha_1,
      round(round(CAST(kg2 AS DOUBLE) * 1e6) / (round(plot_area_ha * 100) * 1e4)) / 1000 AS agb2_mgha_1
    FROM (SELECT s.*, n.subplot_count, {area('n.subplot_count')} AS plot_area_ha FROM (
      SELECT source_code, collection_code, lat, long, yr AS census_date,
        CAST(coalesce(sum(CAST(round(agb_tree_kg * 100) AS BIGINT)), 0) AS DOUBLE) AS k100,
        coalesce(sum(CAST(agb2_tree_kg AS DECIMAL(30, 6))), 0) AS kg2,
        CASE WHEN count(stand_age) = count(*) THEN {mean2('stand_age')} END AS stand_age,
        {mean2('height')} AS height
      FROM agb WHERE census = 3 AND diameter IS NOT NULL
      GROUP BY source_code, collection_code, lat, long, yr) s JOIN subplots3 n USING (source_code))"""

for _k in (1, 2):
    T[f"coords{_k}"] = f"""SELECT source_code, lat, long FROM (
      SELECT source_code, lat, long, row_number() OVER (
        PARTITION BY source_code ORDER BY subplot, tag, lat, long) AS rn
      FROM keyed WHERE census = {_k} AND subplot IS NOT NULL) WHERE rn = 1"""


def _plot_key(k: int, source: str, columns: str) -> str:
    return f"""SELECT r.plot, n.early_name AS estado,
        CAST(r.plot AS VARCHAR) || '_' || coalesce(CAST(s.state_id AS VARCHAR), 'NA') AS source_code, {columns}
      FROM ({source}) r JOIN nat n ON n.nk = ((r.plot % 25) + 25) % 25
      LEFT JOIN state_of s ON s.std_name = {std('n.early_name')}"""


for _k in (1, 2):
    T[f"registry{_k}"] = _plot_key(
        _k,
        f"""SELECT p_partkey AS plot, {YEAR_OF[_k].replace('plot', 'p_partkey')} AS anio,
          CASE p_size % 5 WHEN 0 THEN 'Propiedad Particular' WHEN 1 THEN 'Ejidal' WHEN 2 THEN 'Comunal'
               WHEN 3 THEN 'Propiedad Federal' END AS tenencia FROM part""",
        "r.tenencia, r.anio",
    )
    T[f"impacts{_k}"] = _plot_key(
        _k,
        f"""SELECT o_custkey AS plot, CASE o_orderpriority WHEN '1-URGENT' THEN 'Incendios'
          WHEN '2-HIGH' THEN 'Plagas' WHEN '3-MEDIUM' THEN 'Tala'
          WHEN '4-NOT SPECIFIED' THEN 'Pastoreo' END AS causa
        FROM orders WHERE (o_orderdate < TIMESTAMP '1998-01-01') = {'true' if _k == 1 else 'false'}""",
        "r.causa",
    )
    T[f"fires{_k}"] = _plot_key(
        _k,
        f"""SELECT plot, {YEAR_OF[_k]} AS anio, anio_incendio, tipo_incendio FROM (
          SELECT c_custkey - (c_nationkey + {_k}) % 3 AS plot,
            CASE c_mktsegment WHEN 'BUILDING' THEN 'Año actual' WHEN 'AUTOMOBILE' THEN 'Años anteriores'
              WHEN 'MACHINERY' THEN '2003' WHEN 'FURNITURE' THEN '1998' END AS anio_incendio,
            CASE c_nationkey % 3 WHEN 0 THEN 'Superficial' WHEN 1 THEN 'De copa' END AS tipo_incendio
          FROM customer)""",
        "r.anio, r.anio_incendio, r.tipo_incendio",
    )
    T[f"disturbed{_k}"] = f"""SELECT coalesce(r.source_code, d.source_code) AS source_code,
        r.tenencia, r.anio, d.causa, d.anio_incendio, d.tipo_incendio
      FROM registry{_k} r FULL JOIN (
        SELECT coalesce(i.source_code, f.source_code) AS source_code, i.causa, f.anio_incendio, f.tipo_incendio
        FROM impacts{_k} i FULL JOIN fires{_k} f ON i.source_code = f.source_code) d
      ON r.source_code = d.source_code"""
    T[f"caused{_k}"] = f"""SELECT d.*, n.status FROM (
        SELECT *, CASE WHEN causa = 'Incendios' THEN causa || '_' || coalesce(tipo_incendio, 'NA')
          ELSE causa END AS status_es FROM disturbed{_k}) d LEFT JOIN cause_names n USING (status_es)"""
    T[f"meta{_k}"] = f"""SELECT source_code, tenencia, anio_incendio, anio,
        string_agg(DISTINCT coalesce(status_es, 'NA'), ';' ORDER BY coalesce(status_es, 'NA')) AS source_vegetation_status_es,
        string_agg(DISTINCT coalesce(status, 'NA'), ';' ORDER BY coalesce(status, 'NA')) AS source_vegetation_status
      FROM caused{_k} GROUP BY source_code, tenencia, anio_incendio, anio"""

T["cause_names"] = """SELECT status_es, min(status) AS status FROM (VALUES
      ('Incendios_Superficial', 'surface fire'), ('Incendios_De copa', 'crown fire'), ('Incendios_NA', 'fire'),
      ('Plagas', 'pests'), ('Plagas', 'insects'), ('Tala', 'logging')) AS v(status_es, status) GROUP BY status_es"""
T["classes"] = """SELECT * FROM (VALUES ('Pine forest', 'bosque de pino', 'Temperate'),
      ('Oak forest', 'bosque de encino', 'Temperate'), ('Tall evergreen forest', 'selva alta', 'Tropical'),
      ('Low forest, secondary', 'selva baja con vegetacion secundaria', 'Tropical'),
      ('Xeric shrubland', 'matorral xerofilo', 'Arid')) AS v(class_en, class_es, climate)"""
T["owners"] = """SELECT * FROM (VALUES ('Propiedad Particular', 'private'), ('Ejidal', 'ejido'),
      ('Comunal', 'community'), ('Propiedad Federal', 'federal')) AS v(tenencia, land_ownership)"""

for _k in (1, 2):
    _carry = ", r.agb_plot, r.std_state" if _k == 2 else ""
    T[f"c{_k}"] = f"""SELECT {collection('s.state_id')} AS collection_code,
        'INFYS_' || r.source_code AS source_code, x.lat, x.long, r.census_date, r.agb_mgha_1,
        'EQ_016' AS agb_eq1, v.class_en AS source_vegetation_class, lower(r.veg) AS source_vegetation_class_es,
        r.stand_age, r.height, r.plot_area_ha, m.source_vegetation_status_es, m.source_vegetation_status,
        CASE WHEN m.anio_incendio = 'Año actual' THEN m.anio
             WHEN m.anio_incendio = 'Años anteriores' THEN NULL
             ELSE TRY_CAST(m.anio_incendio AS INT) END AS source_vegetation_status_year,
        o.land_ownership{_carry}
      FROM rollup{_k} r LEFT JOIN meta{_k} m ON m.source_code = r.source_code
      LEFT JOIN coords{_k} x ON x.source_code = r.source_code
      LEFT JOIN classes v ON v.class_es = lower(r.veg)
      LEFT JOIN owners o ON o.tenencia = m.tenencia
      LEFT JOIN state_of s ON s.std_name = r.std_state"""

T["registry3"] = f"""SELECT plot, code AS cve_estado_c3, CAST(plot + 100000 AS INT) AS upmid,
      'INFYS_' || CAST(plot AS VARCHAR) || '_' || CAST(code AS VARCHAR) AS source_code, late_name AS state_name,
      'UMAFOR ' || p_brand AS umafor, {VEG_LATE} AS veg, 'Ecorregión ' || p_type AS ecoregion, p_type,
      CASE p_size % 4 WHEN 0 THEN 'EJIDO' WHEN 1 THEN 'COMUNIDAD' WHEN 2 THEN 'Ejido' END AS nucleus,
      CASE p_size % 9 WHEN 0 THEN 'No capturado' WHEN 1 THEN 'No aplica' WHEN 2 THEN '' WHEN 3 THEN 'Ejidal'
        WHEN 4 THEN 'Propiedad particular' WHEN 5 THEN 'Propiedad federal' WHEN 6 THEN 'Comunal'
        WHEN 8 THEN 'Comunidad agraria' END AS tenure
    FROM (SELECT *, p_partkey AS plot FROM part) JOIN nat ON nk = {STATE_OF}"""

_OWNER = "CASE WHEN owner0 = '' THEN 'unkown' ELSE owner0 END"
for _a, _b in [
    ("EJIDO", "ejido"), ("Ejido", "ejido"), ("Ejidal", "ejido"), ("Comunal", "community"),
    ("Comunidad", "community"), ("COMUNIDAD", "community"),
    ("Propiedad particular", "private"), ("Propiedad federal", "federal"),
]:
    _OWNER = f"regexp_replace({_OWNER}, '{_a}', '{_b}')"
T["meta3"] = f"""SELECT source_code, cve_estado_c3, upmid, umafor, ecoregion, 75 AS minimum_dbh_plot,
      {_OWNER} AS land_ownership, {fold('veg')} AS source_vegetation_class_es, plot, tenure, nucleus
    FROM (SELECT *, CASE WHEN tenure IN ('No capturado', 'No aplica') THEN nucleus ELSE tenure END AS owner0
      FROM registry3)"""

T["hits3"] = """SELECT 'INFYS_' || CAST(s_suppkey AS VARCHAR) || '_' || CAST(n.code AS VARCHAR) AS source_code,
      CASE WHEN s_acctbal < 3000 THEN 'fire' WHEN s_acctbal < 6000 THEN 'pests' END AS disturbance_en
    FROM supplier JOIN nat n ON n.nk = s_suppkey % 25"""

T["numbered3"] = """SELECT *, coalesce(collection_code, 'NA') || '_PL' || printf('%04d', rk) AS plot_code FROM (
      SELECT *, dense_rank() OVER (ORDER BY public_code) AS rk FROM (
        SELECT *, 'INFYS_' || source_code AS public_code FROM rollup3))"""
T["c3"] = """SELECT n.collection_code, n.plot_code, n.public_code AS source_code, n.lat, n.long, n.agb_mgha_1,
      n.agb2_mgha_1, 'EQ_016' AS agb_eq1, 'NI_eq' AS agb_eq2, n.census_date, n.subplot_count, n.stand_age,
      n.height, n.plot_area_ha, 'Mexico' AS country, 0 AS usage_policy, 1 AS stem_level_available,
      m.cve_estado_c3, m.upmid, m.umafor, m.ecoregion, m.minimum_dbh_plot, m.land_ownership,
      m.source_vegetation_class_es, v.class_en AS source_vegetation_class,
      concat_ws(';', d.disturbance_en, CASE WHEN contains(m.source_vegetation_class_es, 'vegetacion secundaria')
        THEN 'secondary vegetation' END) AS source_vegetation_status
    FROM numbered3 n LEFT JOIN (SELECT DISTINCT source_code, cve_estado_c3, upmid, umafor, ecoregion,
        minimum_dbh_plot, land_ownership, source_vegetation_class_es FROM meta3) m ON m.source_code = n.public_code
    LEFT JOIN classes v ON v.class_es = m.source_vegetation_class_es
    LEFT JOIN (SELECT DISTINCT * FROM hits3) d ON d.source_code = n.public_code
    WHERE n.collection_code IS NOT NULL"""

# Panel measures: name, type, censuses that have it.
MEASURES = [
    ("agb_mgha_1", "DOUBLE", "123"),
    ("agb2_mgha_1", "DOUBLE", "3"),
    ("census_date", "INT", "123"),
    ("source_vegetation_class", "VARCHAR", "123"),
    ("source_vegetation_class_es", "VARCHAR", "123"),
    ("height", "DOUBLE", "123"),
    ("land_ownership", "VARCHAR", "123"),
    ("plot_area_ha", "DOUBLE", "123"),
    ("source_vegetation_status", "VARCHAR", "123"),
    ("source_vegetation_status_es", "VARCHAR", "12"),
    ("source_vegetation_status_year", "INT", "12"),
    ("agb_eq1", "VARCHAR", "123"),
    ("agb_eq2", "VARCHAR", "3"),
    ("stand_age", "DOUBLE", "123"),
    ("subplot_count", "BIGINT", "3"),
    ("umafor", "VARCHAR", "3"),
    ("upmid", "INT", "3"),
    ("ecoregion", "VARCHAR", "3"),
]


def _pick(k: int, alias: str) -> str:
    return ", ".join(
        f"{alias}.{m} AS {m}" if str(k) in have else f"CAST(NULL AS {kind}) AS {m}"
        for m, kind, have in MEASURES
    )


T["aligned"] = """SELECT coalesce(c1.source_code, c2.source_code, c3.source_code) AS source_code,
      c1 AS a, c2 AS b, c3 AS c
    FROM c1 FULL JOIN c2 ON c1.source_code = c2.source_code
    FULL JOIN c3 ON coalesce(c1.source_code, c2.source_code) = c3.source_code"""
_WIDE = """source_code, coalesce(c.lat, b.lat, a.lat) AS latitude, coalesce(c.long, b.long, a.long) AS longitude,
      coalesce(a.collection_code, b.collection_code, c.collection_code) AS collection_code, b.agb_plot AS agb_plot_c2"""
T["long_join"] = " UNION ALL ".join(
    f"SELECT {_WIDE}, 'c{k}' AS census, {_pick(k, x)} FROM aligned" for k, x in ((1, "a"), (2, "b"), (3, "c"))
)
T["stacked"] = " UNION ALL ".join(
    f"SELECT source_code, lat, long, collection_code, 'c{k}' AS census,"
    f" {'agb_plot' if k == 2 else 'CAST(NULL AS DOUBLE)'} AS agb_plot, {_pick(k, f'c{k}')} FROM c{k}"
    for k in (1, 2, 3)
)
T["plot_wide"] = """SELECT source_code,
      coalesce(min(CASE WHEN census = 'c3' THEN p END), min(CASE WHEN census = 'c2' THEN p END),
               min(CASE WHEN census = 'c1' THEN p END)) AS p,
      coalesce(min(CASE WHEN census = 'c1' THEN collection_code END), min(CASE WHEN census = 'c2' THEN collection_code END),
               min(CASE WHEN census = 'c3' THEN collection_code END)) AS collection_code,
      min(agb_plot) AS agb_plot_c2
    FROM (SELECT *, CASE WHEN lat IS NOT NULL THEN {'lat': lat, 'long': long} END AS p FROM stacked) GROUP BY source_code"""
T["long_union"] = f"""SELECT s.source_code, w.p.lat AS latitude, w.p.long AS longitude, w.collection_code,
      w.agb_plot_c2, s.census, {', '.join('s.' + m for m, _, _ in MEASURES)}
    FROM stacked s JOIN plot_wide w USING (source_code)"""

_TIES = ["source_vegetation_class", "source_vegetation_status", "land_ownership"]
_FIRST = ["census_date", *_TIES, "census"]
ORDER = ", ".join(
    f"{c} NULLS LAST"
    for c in [*_FIRST, *[m for m, _, _ in MEASURES if m not in _FIRST], "latitude", "longitude", "agb_plot_c2", "collection_code"]
)


def changed(source: str) -> str:
    return f"""SELECT *, census_date - before AS year_diff,
        round(CAST(CAST(round(agb_mgha_1 * 1e3) AS BIGINT) - CAST(round(agb_before * 1e3) AS BIGINT) AS DOUBLE)
          / nullif((census_date - before) * 1e1, 0)) / 1e2 AS agb_change,
        census_date - start AS total_year_diff,
        (agb_mgha_1 - agb_start) / nullif(CAST(census_date - start AS DOUBLE), 0) AS agb_change_total
      FROM (SELECT *, lag(census_date) OVER w AS before, lag(agb_mgha_1) OVER w AS agb_before,
          first_value(census_date) OVER w AS start, first_value(agb_mgha_1) OVER w AS agb_start
        FROM {source} WINDOW w AS (PARTITION BY source_code ORDER BY {ORDER}))"""


T["features"] = f"""SELECT source_code, forest_type, state, ecoregion_desecon4, {fold('state')} AS state_std,
      (SELECT min(s.code) FROM states s WHERE s.name = r.state) AS cve_state, {fold('forest_type')} AS source_veg_class
    FROM (SELECT source_code, veg AS forest_type, state_name AS state, ecoregion || ' 1' AS ecoregion_desecon4
      FROM registry3) r"""


def _panel(name: str, source: str) -> None:
    T[f"{name}_clean"] = f"""SELECT * REPLACE (
        lower(replace(source_vegetation_class, chr(160), ' ')) AS source_vegetation_class,
        lower(replace(source_vegetation_class_es, chr(160), ' ')) AS source_vegetation_class_es) FROM {source}"""
    T[f"{name}_changed"] = changed(f"{name}_clean")
    kept = ", ".join(
        f"n.{m}" for m, _, _ in MEASURES if m not in ("subplot_count", "source_vegetation_class")
    )
    T[name] = f"""SELECT n.collection_code, coalesce(n.collection_code, 'NA') || '_PL' || printf('%04d', n.rk) AS plot_code,
        n.source_code, substr(n.census, 2) AS which_census, {kept},
        coalesce(v.class_en, n.source_vegetation_class_es) AS source_vegetation_class,
        n.latitude AS lat, n.longitude AS long, n.agb_plot_c2, n.year_diff, n.agb_change,
        75 AS minimum_dbh_plot, 'Mexico' AS country, 1 AS stem_level_available, 0 AS usage_policy,
        f.forest_type, f.state, f.ecoregion_desecon4, f.state_std, f.cve_state, f.source_veg_class
      FROM (SELECT *, dense_rank() OVER (PARTITION BY collection_code ORDER BY source_code) AS rk
        FROM {name}_changed WHERE agb_mgha_1 IS NOT NULL) n
      LEFT JOIN classes v ON v.class_es = n.source_vegetation_class_es
      LEFT JOIN features f ON f.source_code = n.source_code"""


_panel("panel", "long_union")
_panel("panel_join", "long_join")

# One row per plot and census, the first in tie order, then aligned.
_COLUMNS = {
    1: "collection_code lat long census_date agb_mgha_1 agb_eq1 source_vegetation_class_es stand_age height"
    " plot_area_ha source_vegetation_status_es source_vegetation_status_year",
    3: "collection_code plot_code lat long agb_mgha_1 agb2_mgha_1 agb_eq1 agb_eq2 census_date subplot_count"
    " stand_age height plot_area_ha country usage_policy stem_level_available cve_estado_c3 upmid umafor"
    " ecoregion minimum_dbh_plot source_vegetation_class_es",
}
_COLUMNS[2] = _COLUMNS[1] + " agb_plot std_state"
for _k in (1, 2, 3):
    _by = ", ".join(f"{c} NULLS LAST" for c in [*_TIES, *_COLUMNS[_k].split()])
    T[f"one{_k}"] = f"""SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY source_code ORDER BY {_by}) AS rn FROM c{_k}) WHERE rn = 1"""
T["aligned_one"] = re.sub(r"\bc([123])\b", r"one\1", T["aligned"])
T["long_one"] = T["long_join"].replace("FROM aligned", "FROM aligned_one")
_panel("panel_one", "long_one")

T["bgb"] = """SELECT *, CASE WHEN carbon_mg = 0 AND climate IN ('Tropical', 'Temperate') THEN 0e0
        WHEN climate = 'Tropical' THEN exp(-1.0587e0 + 0.8836e0 * ln(carbon_mg))
        WHEN climate = 'Temperate' THEN exp(-1.0587e0 + 0.8836e0 * ln(carbon_mg) + 0.2840e0) END AS bgb_mg
    FROM (SELECT p.*, v.climate, p.agb_mgha_1 * 0.47e0 AS carbon_mg
      FROM panel p LEFT JOIN classes v ON v.class_es = p.source_vegetation_class_es)"""

T["methods"] = " UNION ALL ".join(
    f"SELECT source_code, tag, subplot, lat, long, '{m}' AS agb_type, {m} AS agb_value FROM agb"
    f" WHERE census = 3 AND diameter IS NOT NULL AND {m} IS NOT NULL"
    for m in ("agb_tree_kg", "agb2_tree_kg", "agb3_tree_kg")
)


def _used(sql: str) -> list[str]:
    names = re.findall(r"(?:FROM|JOIN)\s+(\w+)\b", sql)
    return [n for n in dict.fromkeys(names) if n in T]


def with_tables(select: str) -> str:
    """The select behind exactly the table expressions it needs, each after its inputs."""
    order: list[str] = []

    def place(sql: str) -> None:
        for name in _used(sql):
            if name not in order:
                place(T[name])
                order.append(name)

    place(select)
    if not order:
        return select
    ctes = ",\n".join(f"{name} AS (\n    {T[name]}\n)" for name in order)
    return f"WITH {ctes}\n{select}"
