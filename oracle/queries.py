"""One SQL text per query name."""

from __future__ import annotations

from oracle.tables import MEASURES, area, changed, collection, fold, std, with_tables

_PLOT12 = (
    "collection_code, source_code, lat, long, census_date, agb_mgha_1, agb_eq1, source_vegetation_class,"
    " source_vegetation_class_es, stand_age, height, plot_area_ha, source_vegetation_status_es,"
    " source_vegetation_status, source_vegetation_status_year, land_ownership"
)
_MEASURE_NAMES = ", ".join(m for m, _, _ in MEASURES)
_LONG = (
    f"source_code, latitude, longitude, collection_code, agb_plot_c2, census, {_MEASURE_NAMES}"
)
_TREE = (
    "source_code, subplot, tag AS tag_number, yr AS census_date, lat, long, family, full_species,"
    " round(wood_density, 6) AS wood_density, level_wd, height, stand_age, agb_tree_kg"
)
_STEMS = """(SELECT l_orderkey, l_partkey, l_linenumber, l_quantity AS d, p_retailprice / 2000 AS wd,
    l_discount * 300 AS h FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_BGB_DROPS = "forest_type, state, ecoregion_desecon4, state_std, cve_state, source_veg_class"

_RAW_SQL = {
    "read_inventory_csv": """SELECT CAST(plot AS INT) AS conglomerado, state_name AS estado, yr AS anio, 'F1' AS formato,
        veg AS tipo_veg_sv, subplot AS sitio, CAST(tag AS INT) AS arbol, family AS familia_apg, cond AS condicion,
        long AS x, lat AS y, age_text AS edad, sci AS nombre_cientifico_apg, diameter AS diametro_normal,
        raw_height AS altura_total FROM trees WHERE census = 1""",
    "read_inventory_csv_c2": """SELECT CAST(plot AS INT) AS conglomerado, state_name AS estado, yr AS anio, 'F1' AS formato,
        veg AS tipo_veg_sv, subplot AS sitio, CAST(tag AS INT) AS arbol, family AS familia_apg, cond AS condicion,
        long AS x, lat AS y, age_text AS edad, sci AS nombre_cientifico_apg, diameter AS diametro_normal,
        raw_height AS altura_total, l_quantity / 10 AS area_basal FROM trees WHERE census = 2""",
    "read_inventory_csv_c3": """SELECT code AS cve_estado_c3, state_name AS estado_c3,
        CAST(plot + 100000 AS INT) AS upmid, CAST(plot AS INT) AS id_conglomerado, yr AS anio_c3, tag AS arbolado_id_c3,
        'Ecorregión ' || p_type AS desecon4_c3, veg AS descrip_s7_c3, long AS x_c3, lat AS y_c3, subplot AS sitio_c3,
        sci AS nombre_cientifico_apg_c3, family AS familia_apg_c3, apg_genus AS genero_apg_c3,
        apg_epithet AS especie_apg_c3, diameter AS diametro_normal_c3, raw_height AS altura_total_c3,
        reported AS biomasa_kg_c3, cond AS condicion_c3, CAST(age_number AS INT) AS edad_c3
        FROM trees WHERE census = 3""",
    "canonical_columns": """SELECT upmid AS upmid_site_code, full_species AS species, genus, family,
        wd AS basic_wood_density_g_cm3 FROM wood""",
    "write_table": """SELECT census, CAST(plot AS INT) AS plot, subplot, tag AS tag_number, diameter, height FROM cleaned""",
    "rename_by_pattern": """SELECT o_orderkey AS order_orderkey, o_custkey AS order_custkey,
        o_orderstatus AS order_orderstatus FROM orders""",
    "ifelse3": """SELECT CAST(plot AS INT) AS plot, verdict, count(*) AS trees FROM (
        SELECT plot, CASE WHEN (diameter > 1000 OR raw_height > 100) THEN 'beyond'
          WHEN NOT (diameter > 1000 OR raw_height > 100) THEN 'within' END AS verdict
        FROM trees WHERE census = 3) GROUP BY plot, verdict""",
    "disturbance_full_join": """SELECT source_code, tenencia, anio, causa, anio_incendio, tipo_incendio,
        count(*) AS n_rows FROM disturbed1 GROUP BY ALL""",
    "align_censuses": "SELECT source_code, "
    + ", ".join(
        f"{x}.{c} AS {c}_{k}"
        for x, k in (("a", "c1"), ("b", "c2"), ("c", "c3"))
        for c in ("census_date", "agb_mgha_1", "land_ownership", "source_vegetation_status")
    )
    + " FROM aligned",
    "lookup_or_self": """SELECT source_code, census, class_es, coalesce(v.class_en, s.class_es) AS class_name FROM (
        SELECT source_code, census, lower(replace(source_vegetation_class_es, chr(160), ' ')) AS class_es
        FROM long_union) s LEFT JOIN classes v USING (class_es)""",
    "relabel_census": """SELECT source_code, census,
        CASE census WHEN 'c1' THEN '1' WHEN 'c2' THEN '2' WHEN 'c3' THEN '3' END AS which_census, census_date
        FROM long_union""",
    "site_species_density": "SELECT source_code, full_species, mean_wood_density FROM site_full_species",
    "site_genus_density": "SELECT source_code, genus, mean_wood_density FROM site_genus",
    "site_family_density": "SELECT source_code, family, mean_wood_density FROM site_family",
    "plot_rollup_c1": """SELECT source_code, census_date, veg AS source_veg_class_raw, state_name, std_state,
        subplot_count, agb_plot, stand_age, height, plot_area_ha, agb_mgha_1 FROM rollup1""",
    "plot_rollup_c2": """SELECT source_code, census_date, veg AS source_veg_class_raw, std_state,
        subplot_count, agb_plot, stand_age, height, plot_area_ha, agb_mgha_1 FROM rollup2""",
    "plot_rollup_c3": "SELECT * FROM rollup3",
    "count_distinct_na": """SELECT CAST(plot AS INT) AS plot, count(*) AS subplots FROM (
        SELECT DISTINCT plot, subplot FROM trees WHERE census = 1) GROUP BY plot""",
    "distinct_concat": """SELECT source_code,
        string_agg(DISTINCT coalesce(causa, 'NA'), ';' ORDER BY coalesce(causa, 'NA')) AS causes,
        coalesce(string_agg(DISTINCT causa, ';' ORDER BY causa), '') AS named_causes
        FROM impacts1 GROUP BY source_code""",
    "plot_site_map": "SELECT upmid, CAST(plot AS INT) AS plot, code, source_code FROM sites",
    "first_per_key": """SELECT source_code, veg AS forest_type, state_name AS state,
        ecoregion || ' 1' AS ecoregion_desecon4 FROM registry3""",
    "agb_change": f"""SELECT source_code, census, census_date, agb_mgha_1, year_diff, agb_change
        FROM ({changed('long_union')})""",
    "agb_change_join": f"""SELECT source_code, census, census_date, agb_mgha_1, year_diff, agb_change
        FROM ({changed('long_join')})""",
    "agb_change_total": f"""SELECT source_code, census, census_date, total_year_diff,
        round(agb_change_total, 6) AS agb_change_total FROM ({changed('long_union')})""",
    "plot_number_by_collection": """SELECT collection_code, source_code, census, census_date,
        coalesce(collection_code, 'NA') || '_PL' || printf('%04d',
          dense_rank() OVER (PARTITION BY collection_code ORDER BY source_code)) AS plot_code FROM long_union""",
    "plot_number_global": """SELECT collection_code, public_code AS source_code, lat, long, census_date, plot_code
        FROM numbered3""",
    "plot_coordinates": "SELECT source_code, lat, long FROM coords1",
    "windowed_distinct_count": """SELECT CAST(t.plot AS INT) AS plot, subplot, tag AS tag_number, diameter, subplot_count
        FROM trees t JOIN (SELECT plot, count(*) AS subplot_count FROM (
          SELECT DISTINCT plot, subplot FROM trees WHERE census = 3) GROUP BY plot) n ON n.plot = t.plot
        WHERE t.census = 3""",
    "group_concat_broadcast": """SELECT source_code, census, land_ownership, source_vegetation_class,
        coalesce(owners, '') AS owners, coalesce(classes, '') AS classes FROM long_union JOIN (
          SELECT source_code, string_agg(DISTINCT land_ownership, '/' ORDER BY land_ownership) AS owners,
            string_agg(DISTINCT source_vegetation_class, '/' ORDER BY source_vegetation_class) AS classes
          FROM long_union GROUP BY source_code) USING (source_code)""",
    "state_dictionary": "SELECT code, name, std_name FROM states",
    "census_panel_long": f"SELECT {_LONG} FROM long_union",
    "census_panel_join": f"SELECT {_LONG} FROM long_join",
    "census_panel_union": f"SELECT {_LONG} FROM long_union",
    "agb_methods_long": "SELECT source_code, tag, subplot, lat, long, agb_type, agb_value FROM methods",
    "standardize_name": f"SELECT doc_id, {std('text')} AS std_text FROM documents",
    "fold_text": f"SELECT doc_id, {fold('text')} AS folded FROM documents",
    "fold_text_signs": f"""SELECT doc_id, {fold('s')} AS folded, {std('s')} AS std_text FROM (SELECT doc_id,
        text || ' Cañón – El’Alto «Ñandú» “Ærø”… ½ ﬁn: ¿Łódź × þorn?' || lang AS s FROM documents)""",
    "clean_nbsp": """SELECT doc_id, lower(lang || ' ' || source || ' ' || replace(text, chr(160), ' ') || ' ' || lang)
        AS cleaned FROM documents""",
    "state_alias": """SELECT c_custkey, CASE WHEN c_nationkey = 8 THEN 'distrito_federal'
        ELSE 'nuevo_leon_' || CAST(c_nationkey AS VARCHAR) END AS std_name FROM customer""",
    "plot_key": """SELECT c_custkey, k AS source_code, 'INFYS_' || k AS public_code FROM (
        SELECT c_custkey, CAST(c_custkey AS VARCHAR) || '_' ||
          CASE WHEN c_nationkey % 5 = 0 THEN 'NA' ELSE CAST(c_nationkey AS VARCHAR) END AS k FROM customer)""",
    "parse_species": """SELECT CAST(plot AS INT) AS plot, tag AS tag_number, sci AS scientific_name, genus, species,
        full_species FROM named WHERE census = 1""",
    "parse_species_c3": """SELECT CAST(plot AS INT) AS plot, tag AS tag_number, sci AS scientific_name, genus, species,
        full_species FROM named WHERE census = 3""",
    "parse_species_c3_literal": """SELECT plot, tag AS tag_number, sci AS scientific_name, genus, species,
        regexp_replace(regexp_replace(coalesce(genus, 'NA') || ' ' || species, 'Aa', 'Indet sp.'), 'ZZ', 'Indet sp.')
          AS full_species
        FROM (SELECT CAST(plot AS INT) AS plot, tag, sci, genus,
          regexp_replace(coalesce(words[2], 'sp.'), 'x', 'sp.') AS species FROM named WHERE census = 3)""",
    "agb_chave_016": f"""SELECT l_orderkey, l_partkey, l_linenumber, d, wd,
        floor(0.0673e0 * pow(wd * (d * d) * h, 0.976e0) * 100 + 0.5e0) / 100 AS agb_kg FROM {_STEMS}""",
    "agb_chave_005": f"""SELECT l_orderkey, l_partkey, l_linenumber, d, wd,
        floor(0.0559e0 * (wd * (d * d) * h) * 100 + 0.5e0) / 100 AS agb_kg FROM {_STEMS}""",
    "agb_reported": """SELECT CAST(plot AS INT) AS plot, tag AS tag_number, subplot, reported AS reported_kg,
        CASE WHEN diameter <= 1000 AND raw_height <= 100 THEN TRY_CAST(reported AS DOUBLE) END AS agb2_tree_kg
        FROM trees WHERE census = 3""",
    "plot_area_ha": f"""SELECT l_partkey, l_returnflag, subplots, {area('subplots')} AS plot_area_ha FROM (
        SELECT l_partkey, l_returnflag, count(DISTINCT l_linenumber) AS subplots FROM lineitem
        GROUP BY l_partkey, l_returnflag)""",
    "agb_per_hectare": f"""SELECT *, round(100 * round(agb_plot * 100) / round(plot_area_ha * 100)) / 100 AS agb_mgha_1
        FROM (SELECT *, {area('subplots')} AS plot_area_ha FROM (
          SELECT l_partkey, count(DISTINCT l_linenumber) AS subplots,
            round(CAST(sum(CAST(round(kg * 100) AS BIGINT)) AS DOUBLE) / 1000) / 100 AS agb_plot
          FROM (SELECT *, floor(0.0673e0 * pow(0.48e0 * (d * d) * h, 0.976e0) * 100 + 0.5e0) / 100 AS kg FROM {_STEMS})
          GROUP BY l_partkey))""",
    "collection_code": f"""SELECT c_custkey, code AS state_code, {collection('code')} AS collection_code FROM (
        SELECT c_custkey, CASE WHEN c_nationkey <> 7 THEN c_nationkey * 2 - 1 END AS code FROM customer)""",
    "carbon_and_bgb": """SELECT o_orderkey, climate, c AS carbon_mg, round(
          CASE WHEN c = 0 AND climate IN ('Tropical', 'Temperate') THEN 0e0
            WHEN climate = 'Tropical' THEN exp(-1.0587e0 + 0.8836e0 * ln(c))
            WHEN climate = 'Temperate' THEN exp(-1.0587e0 + 0.8836e0 * ln(c) + 0.2840e0) END, 6) AS bgb_mg
        FROM (SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Tropical'
            WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'Temperate'
            WHEN o_orderstatus = 'F' THEN 'Arid' END AS climate,
            0.47e0 * CASE WHEN o_orderstatus = 'P' AND o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 0e0
              ELSE o_totalprice / 1000 END AS c FROM orders)""",
    "climate_of_class": """SELECT source_code, census, source_vegetation_class_es, v.climate
        FROM long_union LEFT JOIN classes v ON v.class_es = source_vegetation_class_es""",
    "fire_status_year": """SELECT CAST(plot AS INT) AS conglomerado, anio, anio_incendio,
        CASE WHEN anio_incendio = 'Año actual' THEN anio WHEN anio_incendio = 'Años anteriores' THEN NULL
          ELSE TRY_CAST(anio_incendio AS INT) END AS fire_year FROM fires1""",
    "disturbance_cause": """SELECT source_code, causa, tipo_incendio, status_es, n_rows FROM (
        SELECT source_code, tenencia, anio, causa, anio_incendio, tipo_incendio, status_es, count(*) AS n_rows
        FROM caused1 GROUP BY ALL)""",
    "ownership_dictionary": """SELECT CAST(plot AS INT) AS conglomerado, r.tenencia, o.land_ownership
        FROM registry1 r LEFT JOIN owners o ON o.tenencia = r.tenencia""",
    "ownership_normalize_c3": """SELECT CAST(plot AS INT) AS id_conglomerado, tenure AS tenencia_c3,
        nucleus AS tip_nuc_c3, land_ownership FROM meta3""",
    "vegetation_status_c3": "SELECT source_code, source_vegetation_class_es, source_vegetation_status FROM c3",
    "registry_features": "SELECT * FROM features",
    "registry_features_standardized": """SELECT * REPLACE (
        (SELECT min(s.code) FROM states s WHERE s.std_name = replace(f.state_std, ' ', '_')) AS cve_state) FROM features f""",
    "wood_density_cascade": """SELECT source_code, tag AS tag_number, subplot, full_species, family,
        round(wood_density, 6) AS wood_density, level_wd FROM dense WHERE census = 1""",
    "wood_density_cascade_c3": """SELECT source_code, tag AS tag_number, subplot, full_species, family,
        round(wood_density, 6) AS wood_density, level_wd FROM dense WHERE census = 3""",
    "wood_density_cascade_c2": """SELECT source_code, tag AS tag_number, subplot, full_species, family,
        round(wood_density, 6) AS wood_density, level_wd FROM dense WHERE census = 2""",
    "global_wood_density": """SELECT census, source_code, tag AS tag_number, subplot, full_species, family,
        round(global_wd, 6) AS global_wd, global_level FROM global_found""",
    "name_densities": """SELECT census, name, round(wd, 6) AS global_wd, level AS global_level FROM name_density""",
    "tree_agb_c1": f"SELECT {_TREE} FROM agb WHERE census = 1",
    "tree_agb_c2": f"SELECT {_TREE} FROM agb WHERE census = 2",
    "tree_agb_c3": f"""SELECT * REPLACE ('INFYS_' || source_code AS source_code) FROM (
        SELECT {_TREE}, agb2_tree_kg, agb3_tree_kg, collection_code FROM agb
        WHERE census = 3 AND diameter IS NOT NULL)""",
    "plot_metadata_c1": "SELECT * FROM meta1",
    "plot_metadata_c2": "SELECT * FROM meta2",
    "plot_metadata_c3": """SELECT source_code, cve_estado_c3, upmid, umafor, ecoregion, minimum_dbh_plot, land_ownership,
        source_vegetation_class_es FROM meta3""",
    "census_plot_table_c1": f"SELECT {_PLOT12} FROM c1",
    "census_plot_table_c2": f"SELECT {_PLOT12}, agb_plot, std_state FROM c2",
    "census_plot_table_c3": "SELECT * FROM c3",
    "panel_with_change": "SELECT * FROM panel",
    "panel_with_change_union": "SELECT * FROM panel",
    "panel_with_change_join": "SELECT * FROM panel_join",
    "panel_with_change_one_row": "SELECT * FROM panel_one",
    "panel_with_bgb": f"""SELECT * EXCLUDE ({_BGB_DROPS}) REPLACE (
        round(bgb_mg, 6) AS bgb_mg) FROM bgb""",
    "class_ownership_history": """SELECT source_code, which_census, census_date,
        coalesce(es, '') AS source_forest_type_es, coalesce(en, '') AS source_forest_type,
        coalesce(own, '') AS source_land_ownership
        FROM panel JOIN (SELECT source_code,
          string_agg(DISTINCT source_vegetation_class_es, '/' ORDER BY source_vegetation_class_es) AS es,
          string_agg(DISTINCT source_vegetation_class, '/' ORDER BY source_vegetation_class) AS en,
          string_agg(DISTINCT land_ownership, '/' ORDER BY land_ownership) AS own
          FROM panel GROUP BY source_code) USING (source_code)""",
    "agb_method_boxstats": """SELECT agb_type, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
        min(CASE WHEN inside THEN agb_value END) AS whisker_low, max(CASE WHEN inside THEN agb_value END) AS whisker_high,
        count(*) FILTER (WHERE NOT inside) AS outliers
        FROM (SELECT *, agb_value BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) AS inside
          FROM methods JOIN (SELECT agb_type, count(*) AS n, quantile_cont(agb_value, 0.25) AS q1,
            quantile_cont(agb_value, 0.5) AS median, quantile_cont(agb_value, 0.75) AS q3
            FROM methods GROUP BY agb_type) USING (agb_type)) GROUP BY agb_type, n, q1, median, q3""",
    "agb_method_fit": " UNION ALL ".join(
        f"""SELECT '{m}' AS agb_type, count(*) AS n, round(regr_slope({m}, agb_tree_kg), 6) AS slope,
        round(regr_intercept({m}, agb_tree_kg), 6) AS intercept, round(regr_r2({m}, agb_tree_kg), 6) AS r2
        FROM agb WHERE census = 3 AND diameter IS NOT NULL AND {m} IS NOT NULL AND agb_tree_kg IS NOT NULL"""
        for m in ("agb2_tree_kg", "agb3_tree_kg")
    ),
    "panel_row_checks": " UNION ALL ".join(
        f"""SELECT '{stage}' AS stage, count(*) AS rows, count(*) - count(source_code) AS null_keys,
        count(DISTINCT source_code) AS distinct_keys FROM {table}"""
        for stage, table in (
            ("census1", "c1"), ("census2", "c2"), ("census3", "c3"), ("aligned", "aligned"), ("panel", "panel"),
        )
    ),
}
_RAW_SQL["coalesce_census"] = """SELECT source_code, coalesce(c.lat, b.lat, a.lat) AS latitude,
    coalesce(c.long, b.long, a.long) AS longitude,
    coalesce(a.collection_code, b.collection_code, c.collection_code) AS collection_code FROM aligned"""
_RAW_SQL["lookup_first"] = """SELECT source_code, status_es, status, n_rows FROM (
    SELECT source_code, tenencia, anio, causa, anio_incendio, tipo_incendio, status_es, status, count(*) AS n_rows
    FROM caused2 GROUP BY ALL)"""
_RAW_SQL["wood_density_cascade_shuffled"] = _RAW_SQL["wood_density_cascade"]
_RAW_SQL["wood_density_cascade_c3_shuffled"] = _RAW_SQL["wood_density_cascade_c3"]
for _k in (1, 2, 3):
    _RAW_SQL[f"clean_sentinels_c{_k}"] = f"""SELECT CAST(plot AS INT) AS plot, subplot, tag AS tag_number, raw_height,
        height, stand_age FROM cleaned WHERE census = {_k}"""


def oracle_sql() -> dict[str, str]:
    """Query name to complete SQL over the test tables."""
    return {name: with_tables(sql) for name, sql in _RAW_SQL.items()}
