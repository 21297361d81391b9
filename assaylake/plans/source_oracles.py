"""DuckDB SQL for the queries of the sources, written from their rules with constants of its own."""

from __future__ import annotations

from assaylake.plans.masters import master_sql
from assaylake.plans.oracles import AA, FLAGGED, HIGHCONF, RATIO, YEARS, clean, norm, seq, sorted_set, to_float, url_pairs, url_part

#: Page texts by part; ``{div}`` stands for integer division.
PAGES = r"""SELECT p_partkey,
  CASE p_partkey % 5 WHEN 0 THEN 'Authors A. Nother, B. Else Title Peptides of ' || p_name || ' J. Food. 12, 3-4 (' || (1990 + p_partkey % 30) || ') Year Source ' || (1990 + p_partkey % 30) || ' Journal' WHEN 1 THEN 'Title ' || p_name || ' Year Source ' || (1985 + p_partkey % 35)
    WHEN 2 THEN 'A book of 1999 and ' || (2000 + p_partkey % 20) WHEN 3 THEN 'Patent without year' ELSE p_name END AS biblio,
  'ID ' || p_partkey || ' Name ' || p_name || ' sequence AGK * * * Function: inhibits ACE Number of residues ' || p_size || ' Activity code ah Activity : ACE inhibitor Chemical mass ' || p_size || '.5 Monoisotopic mass ' || p_size || '.25 '
    || CASE WHEN p_partkey % 2 = 0 THEN 'IC50 : ' || p_size || ' uM * * * ' ELSE 'EC50: n * * * ' END || 'Bibliographic data: Authors S. Mith Title Of ' || p_brand || ' Year Source ' || (1990 + p_partkey % 30) || ' Journal * * * Additional information: SMILES: CC(N) InChI=1S/C2 InChIKey: KEY' || p_size
    || ' Information concerning * * * Database reference: ref ' || p_partkey || ' Total number of entries: ' || p_size AS report,
  'First Peptide  Data ' || p_partkey || ' some name AG~K ' || p_size || '.5 ' || p_size || ' ' || (p_size + 1) || '.0 IC50 Peptide Data no row Peptide Data ' || (p_partkey + 1) || ' other VY 1.5 2 3 EC50 Page 1/' || p_size || ' Search: x Page ' || p_size || ' / 99' AS list_text,
  '<table><tr class="info"><td><a href="d.php?zm_ID=' || p_partkey || '">Report</a></td><td>' || p_partkey || '</td><td>n &amp; ' || p_brand || '</td><td>AGK</td><td>1.5</td><td>1.6</td><td>' || p_size || '.00<br>IC50</td></tr><tr class="info"><td>x</td></tr></table>' AS list_html,
  CASE p_partkey % 4 WHEN 0 THEN p_size || '.40 EC 50' WHEN 1 THEN '-' || p_size || ' ic50' WHEN 2 THEN 'about ' || p_size ELSE ' ' || p_size || '  IC50 x' END AS cell
FROM part"""


def real(x: str) -> str:
    return f"CASE WHEN isfinite({x}) THEN {x} END"


def text(x: str) -> str:
    return f"coalesce({clean(x)}, '')"


def joined(*xs: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(clean(x) for x in xs)}], lambda v: v IS NOT NULL))), ' | ')"


RESOLVED = "('exact_molar', 'molar_threshold')"


def mapped(name: str, level: str, note: str, source: str, where: str, given: dict[str, str]) -> str:
    base = {
        "task": "'ace'", "source_name": f"'{name}'", "source_level": f"'{level}'", "source_record_id": clean("source_record_id"), "sequence": seq("sequence"), "peptide_length": "cast(peptide_length AS int)",
        "sequence_valid_flag": "1", "noncanonical_flag": "0", "ic50_raw": clean("ic50_raw"), "ic50_relation": clean("ic50_relation"), "ic50_value": real("ic50_value"), "ic50_unit": clean("ic50_unit"),
        "ic50_uM": real("ic50_uM"), "ic50_status": clean("ic50_parse_status"), "assay_raw": "''", "source_context_raw": "''", "species_raw": "''", "protein_id_raw": "''", "protein_description_raw": "''",
        "bibliographic_raw": "''", "doi_raw": "''", "database_reference_raw": "''", "is_dipeptide": "cast(coalesce(peptide_length = 2, false) AS int)", "is_tripeptide": "cast(coalesce(peptide_length = 3, false) AS int)", "merge_note": f"'{note}'",
    }
    return f"SELECT {', '.join(f'{v} AS {c}' for c, v in (base | given).items())}, ord FROM ({source}) WHERE {where}"


CRAWLED = f"{seq('sequence')} IS NOT NULL AND peptide_length IS NOT NULL AND isfinite(ic50_uM) AND {clean('ic50_parse_status')} IN {RESOLVED}"
MAPPED = {
    "ahtpdb": mapped("AHTPDB", "ahtpdb_standardized", "mapped_from_ahtpdb_master_clean_um_expanded", master_sql("ahtpdb"), "sequence_valid = 1 AND sequence_has_noncanonical_char = 0 AND isfinite(ic50_uM) AND ic50_type IN ('exact', 'threshold')", {
        "source_record_id": clean("id"), "sequence": seq("sequence_clean"), "peptide_length": "cast(len_clean AS int)", "ic50_unit": clean("ic50_unit_raw"), "ic50_status": "CASE ic50_type WHEN 'exact' THEN 'exact_molar' ELSE 'molar_threshold' END",
        "assay_raw": joined("method_raw", "assay_raw", "mice_raw"), "source_context_raw": joined("source_raw", "table_from"), "is_dipeptide": "is_dipeptide", "is_tripeptide": "is_tripeptide",
    }),
    "biopep": mapped("BIOPEP-UWM", "biopep_core_workset", "mapped_from_biopep_ic50_core_record_level", master_sql("biopep"), CRAWLED, {
        "assay_raw": joined("activity_measure_label_raw", "measure_type_raw", "function_text_raw"), "source_context_raw": joined("source_name", "source_type", "target", "evidence_type"),
        "bibliographic_raw": text("bibliographic_raw"), "database_reference_raw": text("database_reference_raw"),
    }),
    "mbpdb": mapped("MBPDB", "mbpdb_core_workset", "mapped_from_mbpdb_ace_core_record_level", master_sql("mbpdb"), CRAWLED, {
        "assay_raw": joined("function_raw", "inhibition_type_raw", "additional_details_raw"), "source_context_raw": joined("source_name", "source_type", "target", "intervals_raw"), "species_raw": text("species_raw"),
        "protein_id_raw": text("protein_id_raw"), "protein_description_raw": text("protein_description_raw"), "bibliographic_raw": joined("title_raw", "authors_raw", "abstract_raw"), "doi_raw": text("doi_raw"),
    }),
    "fermfood": mapped("FermFooDb", "fermfooddb_core_strict_workset", "mapped_from_fermfooddb_ace_core_strict_record_level", master_sql("fermfood"), CRAWLED, {
        "assay_raw": joined("assay_raw", "method_of_analysis_raw"), "source_context_raw": joined("food_matrix_raw", "culture_raw", "hydrolysis_raw", "experiment_raw", "model_raw"), "protein_description_raw": text("protein_raw"),
        "bibliographic_raw": joined("title_raw", "pubmed_id_raw"), "database_reference_raw": text("detail_url"),
    }),
}
UNION = f"WITH u AS ({' UNION ALL '.join(MAPPED.values())})"
MERGED = UNION + ", m AS (SELECT *, printf('ace_merged_%06d', row_number() OVER (ORDER BY coalesce(peptide_length, 1000000000), coalesce(sequence, ''), source_name, coalesce(source_record_id, ''), ord)) AS merged_record_id FROM u)"


def year_list(x: str, clean_first: bool = True) -> str:
    return YEARS.format(clean(x) if clean_first else x)


STATISTICS = f"min(um) AS ic50_uM_min, max(um) AS ic50_uM_max, round(avg(um), 6) AS ic50_uM_mean, round(median(um), 6) AS ic50_uM_median, round(CASE WHEN min(um) > 0 THEN max(um) / min(um) END, 6) AS {RATIO}"


def sets(names: dict[str, str]) -> str:
    return ", ".join(f"{sorted_set(clean(c))} AS {n}" for n, c in names.items())


MERGED_LEVEL = f"""{MERGED}, y AS (SELECT *, ic50_uM AS um, [list_max({year_list('bibliographic_raw')}), list_max({year_list('doi_raw')}), list_max({year_list('source_context_raw')})] AS ys FROM m WHERE peptide_length IN (2, 3)),
g AS (SELECT sequence, cast(arg_min_null(peptide_length, merged_record_id) AS int) AS peptide_length, count(DISTINCT source_name) AS source_count, count(*) AS record_count_total, count(*) FILTER (source_name = 'AHTPDB') AS record_count_ahtpdb, count(*) FILTER (source_name = 'BIOPEP-UWM') AS record_count_biopep,
  count(*) FILTER (source_name = 'MBPDB') AS record_count_mbpdb, count(*) FILTER (source_name = 'FermFooDb') AS record_count_fermfooddb,
  {sets({'source_name_set': 'source_name', 'merged_record_id_list': 'merged_record_id', 'source_record_id_list': 'source_record_id', 'species_set': 'species_raw', 'protein_id_set': 'protein_id_raw', 'doi_set': 'doi_raw', 'ic50_relation_set': 'ic50_relation', 'ic50_status_set': 'ic50_status', 'database_reference_raw_set': 'database_reference_raw'})},
  {STATISTICS}, min(list_min(ys)) AS bibliographic_year_min, max(list_max(ys)) AS bibliographic_year_max FROM y WHERE sequence IS NOT NULL GROUP BY sequence),
f AS (SELECT *, cast(source_count >= 2 AS int) AS cross_source_overlap_flag, CASE WHEN record_count_total <= 1 THEN 'singleton' WHEN {RATIO} IS NULL THEN 'unknown' WHEN source_count >= 2 AND {RATIO} <= 10 THEN 'cross_source_consistent' WHEN {RATIO} <= 10 THEN 'within_range_consistent' ELSE 'conflicting' END AS stability_flag FROM g)
SELECT *, CASE stability_flag WHEN 'singleton' THEN 'only_one_record_after_merge' WHEN 'unknown' THEN 'spread_ratio_unavailable' ELSE 'source_count=' || source_count || '; spread_ratio=' || printf('%.4f', {RATIO}) END AS stability_note FROM f"""


def has_token(x: str, token: str) -> str:
    return f"list_contains(list_transform(string_split(coalesce({x}, ''), ';'), lambda a: trim(a)), '{token}')"


STATUS = clean("ic50_parse_status")
UNRESOLVED = f"NOT (coalesce({STATUS} IN {RESOLVED}, false) AND coalesce(isfinite(ic50_uM), false))"
ODD = has_token("notes", "non_canonical_or_contains_unknown_residue")
EC50 = " OR ".join(f"contains(lower({text(c)}), 'ec50')" for c in ("measure_type_raw", "activity_measure_label_raw", "ic50_raw", "activity_name_raw", "activity_label_raw"))
REASONS = {
    "biopep": {"unresolved_ic50": UNRESOLVED, "ec50_record": EC50, "noncanonical_or_modified_residue": f"contains({text('sequence')}, '{{') OR contains({text('sequence')}, '}}') OR {ODD}", "length_conflict": f"coalesce({clean('length_consistency_flag')} = 'conflict', false)"},
    "mbpdb": {"missing_or_unresolved_ic50": UNRESOLVED, "noncanonical_or_missing_sequence": f"{clean('sequence')} IS NULL OR {ODD}"},
    "fermfood": {
        "sequence_missing": f"{seq('sequence')} IS NULL", "noncanonical_sequence": f"{seq('sequence')} IS NOT NULL AND NOT regexp_matches({seq('sequence')}, '^[{AA}]+$')", "peptide_length_missing": "peptide_length IS NULL",
        "ic50_status_not_usable": f"NOT coalesce({STATUS} IN ('exact_molar', 'molar_threshold', 'rescued_numeric_no_unit'), false)", "ic50_uM_missing": "NOT coalesce(isfinite(ic50_uM), false)",
    },
}


def reasons(source: str) -> str:
    return f"SELECT *, concat_ws('; ', {', '.join(f'CASE WHEN {c} THEN {n!r} END' for n, c in REASONS[source].items())}) AS reasons FROM ({master_sql(source)})"


def keeps(statuses: str) -> str:
    return f"cast(coalesce(regexp_matches({seq('sequence')}, '^[{AA}]+$'), false) AND coalesce(isfinite(ic50_uM), false) AND coalesce({STATUS} IN {statuses}, false) AS int)"


def workset(source: str) -> str:
    return f"SELECT record_id, CASE WHEN reasons = '' THEN 'strict' ELSE 'excluded' END AS workset_tier, cast(reasons = '' AS int) AS workset_keep_flag, reasons AS workset_exclusion_reasons FROM ({reasons(source)})"


def routes(source: str, names: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT record_id, '{n}' AS route FROM ({reasons(source)}) WHERE list_contains(string_split(reasons, '; '), '{r}')" for n, r in names.items())


def level(source: str, key: str, kept: str, names: dict[str, str], years: str, more: str = "") -> str:
    return f"""WITH k AS (SELECT *, {key} AS s, {real('ic50_uM')} AS um, {years} AS ys FROM ({reasons(source)}) WHERE {kept}),
    g AS (SELECT s AS sequence, cast(arg_min_null(peptide_length, ord) AS int) AS peptide_length, count(*) AS record_count, {sets(names)}, {STATISTICS}, min(list_min(ys)) AS bibliographic_year_min, max(list_max(ys)) AS bibliographic_year_max FROM k WHERE s IS NOT NULL GROUP BY s)
    SELECT *{more} FROM g"""


DIGITS = f"left(regexp_replace({clean('bibliographic_year_raw')}, '\\D', '', 'g'), 4)"
FLAG = f"CASE WHEN record_count <= 1 THEN 'singleton' WHEN {RATIO} IS NULL THEN 'unknown' WHEN {RATIO} <= 10 THEN 'within_range_consistent' ELSE 'conflicting' END"
FLAG_NOTE = f"CASE WHEN record_count <= 1 THEN 'only_one_record_in_fermfoodb' WHEN {RATIO} IS NULL THEN 'spread_ratio_unavailable' ELSE 'spread_ratio=' || printf('%.4f', {RATIO}) END"
UNIT = "replace(lower(translate(ic50_unit_raw, 'μµ', 'uu')), ' ', '')"
CONVERTED = f"""WITH c AS (SELECT *, CASE WHEN ic50_type = 'mass_unit' AND ic50_relation = '=' AND ic50_value > 0 AND molwt_value > 0 THEN CASE {UNIT} WHEN 'mg/ml' THEN ic50_value * 1e6 / molwt_value WHEN 'ug/ml' THEN ic50_value * 1e3 / molwt_value END END AS um, {UNIT} AS u FROM ({master_sql('ahtpdb')}))"""
FORMULA = "CASE WHEN um IS NULL THEN '' WHEN u = 'mg/ml' THEN 'uM = (mg/mL * 1000000) / molwt_value' ELSE 'uM = (ug/mL * 1000) / molwt_value' END AS unit_conversion_formula, CASE WHEN um IS NULL THEN '' WHEN u = 'mg/ml' THEN 'mass_unit_mg_per_mL_converted_to_uM' ELSE 'mass_unit_ug_per_mL_converted_to_uM' END AS unit_conversion_note"
FIELDS = {
    "pubmed_id_raw": ("pubmed_id", "pubmed_id"), "title_raw": ("detail_title", "title"), "protein_raw": ("protein_name", "protein"), "food_matrix_raw": ("food_matrix", "food_matrix"), "culture_raw": ("starter_culture", "culture"),
    "hydrolysis_raw": ("hydrolysis", "hydrolysis"), "experiment_raw": ("experiment", "experiment"), "model_raw": ("model", "model"), "assay_raw": ("assay_for_activity_measurement", "assay_for_activity_measurement"),
    "method_of_analysis_raw": ("method_of_analysis", "method_of_analysis"), "mz_ratio_raw": ("mz_ratio", "mz_ratio"), "mass_raw": ("mass", "mass"), "detail_url": ("detail_url", "detail_url"), "activity_label_raw": ("activity", "activity"),
    "ph_raw": ("ph", "ph"), "temperature_raw": ("temperature", "temperature"), "incubation_time_raw": ("incubation_time", "incubation_time"), "ic50_raw": ("ic50_raw", "ic50_raw"),
}
LIST_COLUMNS = "list_page_no list_page_url row_no_on_page fmdb_id detail_url pubmed_id title peptide_sequence length_of_peptide food_matrix protein ph temperature incubation_time activity experiment model assay_for_activity_measurement culture hydrolysis method_of_analysis mz_ratio mass ic50_raw".split()
DETAIL_COLUMNS = "fmdb_id detail_url detail_title pubmed_id peptide_sequence length_of_peptide food_matrix protein_name ph temperature incubation_time activity experiment model assay_for_activity_measurement starter_culture hydrolysis method_of_analysis mz_ratio mass ic50_raw detail_text_path detail_html_path".split()


def richest(table: str, columns: list[str]) -> str:
    score = " + ".join(f"cast({clean(c)} IS NOT NULL AS int)" for c in columns)
    return f"SELECT * FROM (SELECT *, {clean('fmdb_id')} AS k, row_number() OVER (PARTITION BY {clean('fmdb_id')} ORDER BY {score} DESC, row_id) AS rn FROM {table}) WHERE rn = 1 AND k IS NOT NULL"


BACKFILLED = f"""WITH d AS ({richest('fermfoodb_ace_detail', DETAIL_COLUMNS)}), l AS ({richest('fermfoodb_ace_list', LIST_COLUMNS)}),
b AS (SELECT t.row_id, {", ".join(f"coalesce({clean(f't.{f}')}, {clean(f'd.{a}')}, {clean(f'l.{c}')}) AS {f}, cast({clean(f't.{f}')} IS NULL AND coalesce({clean(f'd.{a}')}, {clean(f'l.{c}')}) IS NOT NULL AS int) AS {f}_filled" for f, (a, c) in FIELDS.items())}
  FROM fermfoodb_ace_master_clean t LEFT JOIN d ON d.k = {clean('t.source_record_id')} LEFT JOIN l ON l.k = {clean('t.source_record_id')})"""
P = f"WITH pages AS ({PAGES.replace('{div}', '//')})"


def pick(x: str, p: str, g: int = 1) -> str:
    return f"regexp_extract({x}, '(?is){p}', {g})"


def first(x: str, p: str) -> str:
    return norm(pick(x, p))


ROW = r"^\s*([0-9]+)\s+(.+?)\s+([A-Za-z0-9~\-*.]+)\s+([0-9]+(?:\.[0-9]+)?)\s+([0-9]+(?:\.[0-9]+)?)\s+([0-9]+(?:\.[0-9]+)?)\s+((?:IC|EC)50)\b"
CELL = r"(-?[0-9]+(?:\.[0-9]+)?)\s*((?:IC|EC)50)\b"
BIB, INFO = norm(pick("report", r"Bibliographic data:\s*(.*?)\s*\*\s*\*\s*\*")), norm(pick("report", r"Additional information:\s*(.*?)\s*\*\s*\*\s*\*"))
TITLE = norm(pick("biblio", r"Title\s+(.+?)\s+Year\s+Source\s+[0-9]{4}"))
TITLE = norm(rf"regexp_replace({TITLE}, '\s+[A-Z][A-Za-z.\-]+.*?\([0-9]{{4}}\)\s*$', '')")
KIND = norm(pick("biblio", r"Year\s+Source\s+[0-9]{4}\s+([A-Za-z][A-Za-z \-/]+)$"))


def candidate(k: str, v: str) -> str:
    """The page URL with key ``k`` set, in canonical form: pairs sorted by key, then value."""
    others = f"list_filter({url_pairs('list_page_url')}, lambda a: string_split(a, chr(1))[1] <> '{k}')"
    query = f"replace(array_to_string(list_sort(list_append({others}, '{k}' || chr(1) || ({v}))), '&'), chr(1), '=')"
    path = f"regexp_replace({url_part('list_page_url', 3)}, '/+', '/', 'g')"
    return f"lower({url_part('list_page_url', 1)}) || '://' || lower({url_part('list_page_url', 2)}) || CASE WHEN {path} = '' THEN '/' ELSE {path} END || '?' || {query}"


CANDIDATES = [candidate(k, "page + 1") for k in ("page", "pageno", "Page", "PageNo")] + [candidate(k, "page * 50") for k in ("start", "offset")]
SHORT = "CASE WHEN peptide_length = 2 THEN 0 ELSE 1 END"
ORACLES = {
    "source_mapping": f"{UNION} SELECT * REPLACE (round(ic50_value, 6) AS ic50_value, round(ic50_uM, 6) AS ic50_uM) FROM u",
    "merged_master": f"{MERGED} SELECT merged_record_id, source_name, source_record_id, sequence, peptide_length FROM m",
    "merged_sequence_level": MERGED_LEVEL,
    "merge_summary": f"{UNION} " + " UNION ALL ".join([
        *[f"SELECT '{s}_input_rows' AS metric, count(*) AS value FROM ({master_sql(s)})" for s in MAPPED], "SELECT 'merged_source::' || source_name, count(*) FROM u GROUP BY 1",
        "SELECT 'short_source::' || source_name, count(*) FROM u WHERE peptide_length IN (2, 3) GROUP BY 1", "SELECT 'merged_record_level_rows', count(*) FROM u", "SELECT 'merged_short_2_3_record_level_rows', count(*) FROM u WHERE peptide_length IN (2, 3)",
    ]),
    "biopep_workset": workset("biopep"), "mbpdb_workset": workset("mbpdb"),
    "fermfood_worksets": f"SELECT row_id, {keeps(RESOLVED)} AS strict_keep, {keeps('(' + repr('exact_molar') + ', ' + repr('molar_threshold') + ', ' + repr('rescued_numeric_no_unit') + ')')} AS expanded_keep, reasons FROM ({reasons('fermfood')})",
    "biopep_routes": routes("biopep", {"ec50": "ec50_record", "noncanonical": "noncanonical_or_modified_residue", "length_conflict": "length_conflict"}),
    "mbpdb_routes": routes("mbpdb", {"missing_ic50": "missing_or_unresolved_ic50", "noncanonical": "noncanonical_or_missing_sequence"}),
    "biopep_sequence_level": level("biopep", clean("sequence"), "reasons = ''", {"record_id_list": "record_id", "source_record_id_list": "source_record_id", "source_name_set": "source_name", "ic50_parse_status_set": "ic50_parse_status", "ic50_relation_set": "ic50_relation", "detail_report_url_list": "detail_report_url", "notes_set": "notes"},
        f"CASE WHEN length({DIGITS}) = 4 AND cast({DIGITS} AS int) BETWEEN 1800 AND 2100 THEN [cast({DIGITS} AS int)] ELSE []::int[] END"),
    "mbpdb_sequence_level": level("mbpdb", clean("sequence"), "reasons = ''", {"record_id_list": "record_id", "source_record_id_list": "source_record_id", "species_set": "species_raw", "protein_id_set": "protein_id_raw", "protein_description_set": "protein_description_raw", "doi_set": "doi_raw", "ic50_relation_set": "ic50_relation", "ic50_parse_status_set": "ic50_parse_status", "title_set": "title_raw", "notes_set": "notes"},
        f"[coalesce(list_min({year_list('title_raw')}), list_min({year_list('doi_raw')}))]"),
    "fermfood_sequence_level": level("fermfood", seq("sequence"), f"{keeps(RESOLVED)} = 1", {
        "source_record_id_list": "source_record_id", "record_id_list": "record_id", "activity_label_set": "activity_label_raw", "food_matrix_set": "food_matrix_raw", "protein_set": "protein_raw", "culture_set": "culture_raw", "hydrolysis_set": "hydrolysis_raw", "experiment_set": "experiment_raw", "model_set": "model_raw",
        "assay_set": "assay_raw", "method_of_analysis_set": "method_of_analysis_raw", "pubmed_id_set": "pubmed_id_raw", "title_set": "title_raw", "ic50_status_set": "ic50_parse_status", "ic50_relation_set": "ic50_relation"},
        f"[list_max({year_list('title_raw')}), list_max({year_list('pubmed_id_raw')})]", f", {FLAG} AS stability_flag, {FLAG_NOTE} AS stability_note"),
    "length_consistency": f"""SELECT row_id, coalesce(n, declared) AS peptide_length, declared, CASE WHEN coalesce(n, declared) IS NULL THEN 'missing_both' WHEN declared IS NULL THEN 'sequence_only' WHEN coalesce(n, declared) = declared THEN 'consistent' ELSE 'conflict' END AS flag
      FROM (SELECT row_id, length({seq('peptide_sequence')}) AS n, cast(floor({to_float('length_of_peptide')}) AS int) AS declared FROM fermfoodb_ace_detail)""",
    "exact_value_counts": f"""WITH m AS (SELECT id, sequence_clean, CASE WHEN ic50_exact_flag = 1 AND isfinite(ic50_uM) THEN ic50_uM END AS v FROM ({master_sql('ahtpdb')})), g AS (SELECT sequence_clean, count(*) AS n, count(DISTINCT v) AS u FROM m GROUP BY 1)
      SELECT id, n AS sequence_dup_count, cast(n > 1 AS int) AS is_duplicate_sequence, u AS exact_unique_count, cast(u > 1 AS int) AS exact_conflict_flag FROM m JOIN g USING (sequence_clean)""",
    "highconf_records": f"SELECT id, sequence_clean, round(ic50_uM, 6) AS ic50_uM FROM ({master_sql('ahtpdb')}) WHERE sequence_valid = 1 AND len_match = 1 AND ic50_exact_flag = 1 AND ic50_type = 'exact' AND isfinite(ic50_uM) AND (is_dipeptide = 1 OR is_tripeptide = 1)",
    "unit_conversion": f"{CONVERTED} SELECT id, CASE WHEN um IS NOT NULL THEN 'exact' ELSE ic50_type END AS ic50_type, CASE WHEN um IS NOT NULL THEN 1 ELSE ic50_exact_flag END AS ic50_exact_flag, round(coalesce(um, ic50_uM), 6) AS ic50_uM, cast(um IS NOT NULL AS int) AS unit_conversion_applied, CASE WHEN um IS NULL THEN '' ELSE ic50_unit_raw END AS unit_conversion_from_unit, CASE WHEN um IS NULL THEN '' ELSE 'uM' END AS unit_conversion_to_unit, {FORMULA} FROM c",
    "unit_conversion_log": f"{CONVERTED} SELECT id, sequence_clean, table_from, ic50_raw, ic50_type AS ic50_type_before, ic50_unit_raw AS from_unit, printf('%.12g', ic50_value) AS ic50_value, printf('%.12g', molwt_value) AS molwt_value, printf('%.12g', um) AS ic50_uM, {FORMULA} FROM c WHERE um IS NOT NULL",
    "consensus_position": f"""{FLAGGED}, p AS (SELECT *, CASE consensus_tier WHEN 'Tier_A' THEN 1 WHEN 'Tier_B' THEN 2 WHEN 'Tier_C' THEN 3 ELSE 9 END AS rank, round(CASE consensus_tier WHEN 'Tier_A' THEN 3000.0::double WHEN 'Tier_B' THEN 2000 WHEN 'Tier_C' THEN 1000 ELSE 0 END + source_count * 20.0::double + record_count_total * 5.0::double + CASE WHEN x > 0 THEN greatest(0.0, 100.0 - least(x, 100.0)) ELSE 0.0 END, 4) AS priority FROM flagged)
      SELECT row_number() OVER (ORDER BY rank, -priority, CASE WHEN coalesce(peptide_length, 0) = 0 THEN 999 ELSE peptide_length END, sequence) AS position, sequence FROM p""",
    "conflict_position": f"""{FLAGGED}, p AS (SELECT *, CASE WHEN x IS NULL THEN 'unknown' WHEN source_count >= 2 AND x >= 100 THEN 'very_high' WHEN x >= 100 THEN 'high' WHEN x >= 10 THEN 'medium' ELSE 'low' END AS conflict_severity FROM flagged WHERE consensus_tier = 'Tier_X')
      SELECT row_number() OVER (ORDER BY CASE conflict_severity WHEN 'very_high' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END, CASE WHEN coalesce(x, 0) = 0 THEN 1.0 ELSE -x END, sequence) AS position, sequence, conflict_severity FROM p""",
    "short_position": f"{HIGHCONF} SELECT row_number() OVER (ORDER BY {SHORT}, CASE stability_class WHEN 'stable' THEN 0 WHEN 'condition-sensitive' THEN 1 WHEN 'high-conflict' THEN 2 ELSE 3 END, um_median, sequence) AS position, sequence FROM hc",
    "stable_position": f"{HIGHCONF} SELECT row_number() OVER (ORDER BY {SHORT}, CASE activity_tier WHEN 'strong' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, um_median, sequence) AS position, sequence, activity_tier FROM st",
    "master_backfill": f"{BACKFILLED} SELECT * FROM b",
    "backfill_report": f"{BACKFILLED} " + " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) - cast(sum({f}_filled) AS bigint) AS n_before, cast(sum({f}_filled) AS bigint) AS n_gain, count({f}) AS n_after FROM b" for f in FIELDS),
    "bibliography": rf"""{P} SELECT p_partkey, nullif({first("biblio", r"Authors\s+(.+?)\s+Title\s+")}, '') AS authors, nullif({TITLE}, '') AS title, coalesce(nullif({pick("biblio", r"Year\s+Source\s+([0-9]{4})")}, ''), regexp_extract_all(biblio, '\b((?:19|20)[0-9]{{2}})\b')[-1]) AS year,
      coalesce(nullif({KIND}, ''), CASE WHEN contains(lower(biblio), 'journal') THEN 'Journal' WHEN contains(lower(biblio), 'book') THEN 'Book' WHEN contains(lower(biblio), 'patent') THEN 'Patent' WHEN contains(lower(biblio), 'database') THEN 'Database' END) AS source_type FROM pages""",
    "report_fields": rf"""{P} SELECT p_partkey, {first("report", r"ID\s+[0-9]+\s+Name\s+(.*?)\s+sequence")} AS name, {first("report", r"sequence\s+(.*?)\s+\*\s*\*\s*\*")} AS sequence, {first("report", r"Function:\s*(.*?)\s*Number of residues")} AS function_text, {first("report", r"Number of residues\s*(.*?)\s*Activity code")} AS number_of_residues,
      {first("report", r"Activity code\s*(.*?)\s*Activity\s*:")} AS activity_code, {first("report", r"Activity\s*:\s*(.*?)\s*Chemical mass")} AS activity_name, {first("report", r"Chemical mass\s*([0-9]+(?:\.[0-9]+)?)")} AS chemical_mass, {first("report", r"Monoisotopic mass\s*([0-9]+(?:\.[0-9]+)?)")} AS monoisotopic_mass,
      upper({first("report", r"\b((?:IC|EC)50)\s*:\s*.*?\s*\*\s*\*\s*\*")}) AS activity_measure_label, {first("report", r"\b(?:IC|EC)50\s*:\s*(.*?)\s*\*\s*\*\s*\*")} AS activity_value_text, {BIB} AS bibliographic_raw, {INFO} AS additional_information_raw, {first("report", r"Database reference:\s*(.*)$")} AS database_reference_raw,
      {first(BIB, r"Authors\s*(.*?)\s*Title")} AS bibliographic_authors, {first(BIB, r"Title\s*(.*?)\s*Year\s+Source")} AS bibliographic_title, {first(BIB, r"Year\s+Source\s*([0-9]{4})")} AS bibliographic_year, {first(BIB, r"Year\s+Source\s*[0-9]{4}\s+(.+)$")} AS bibliographic_source_type,
      {first(INFO, r"SMILES:\s*(.*?)\s*InChI=")} AS smiles, {first(INFO, r"(InChI=[^\n]+)")} AS inchi, {first(INFO, r"InChIKey:\s*(.*?)\s*(?:Information concerning|$)")} AS inchikey FROM pages""",
    "list_text_rows": rf"""{P}, parts AS (SELECT p_partkey, unnest(regexp_split_to_array(regexp_replace(list_text, '(?i)Peptide\s+Data', 'Peptide Data', 'g'), '\bPeptide Data\b')[2:]) AS x FROM pages), cut AS (SELECT p_partkey, trim(regexp_split_to_array({norm('x')}, '\b(?:First\b|Search:|Page\s+[0-9]+\s*/\s*[0-9]+)\b')[1]) AS x FROM parts)
      SELECT p_partkey, {", ".join(f"trim(regexp_extract(x, '(?i){ROW}', {i})) AS {n}" for i, n in enumerate(["peptide_id", "name", "sequence", "chemical_mass", "monoisotopic_mass", "activity_value_raw", "measure_type_raw"], 1))} FROM cut WHERE regexp_matches(x, '(?i){ROW}')""",
    "list_html_rows": f"{P} SELECT p_partkey, p_partkey::varchar AS peptide_id, 'n & ' || p_brand AS name, 'AGK' AS sequence, '1.5' AS chemical_mass, '1.6' AS monoisotopic_mass, p_size || '.00' AS activity_value_raw, 'IC50' AS measure_type_raw, 'd.php?zm_ID=' || p_partkey AS detail_list_url FROM part",
    "activity_cells": rf"""{P}, c AS (SELECT p_partkey, replace(replace({norm('cell')}, 'IC 50', 'IC50'), 'EC 50', 'EC50') AS t FROM pages) SELECT p_partkey, CASE WHEN regexp_matches(t, '(?i){CELL}') THEN regexp_extract(t, '(?i){CELL}', 1) ELSE t END AS value, upper(regexp_extract(t, '(?i){CELL}', 2)) AS measure FROM c""",
    "page_totals": rf"{P} SELECT p_partkey, cast(regexp_extract_all(list_text, 'Page\s+[0-9]+\s*/\s*([0-9]+)', 1)[-1] AS int) AS pages, cast(regexp_extract(lower(report), 'total number of entries.*?([0-9]+)', 1) AS int) AS entries FROM pages",
    "page_candidates": f"WITH t AS (SELECT DISTINCT list_page_url, coalesce(try_cast(list_page_no AS int), 1) AS page FROM fermfoodb_ace_list WHERE list_page_url IS NOT NULL) SELECT DISTINCT list_page_url, page, unnest([{', '.join(CANDIDATES)}]) AS candidate FROM t",
    "activity_filter": f"SELECT row_id, {norm('activity')} AS activity FROM fermfoodb_ace_list WHERE lower({norm('activity')}) = 'ace inhibitory'",
}
