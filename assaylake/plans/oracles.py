"""DuckDB SQL for the queries, written from the definitions, not from the Spark plans."""

from __future__ import annotations

from assaylake.functions import features
from assaylake.functions.numeric import RESIDUE_MASS, WATER
from assaylake.functions.text import MISSING_TOKENS
from assaylake.plans.fixtures import ASSAY

WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
TOKENS = ", ".join(f"'{t}'" for t in MISSING_TOKENS)
AA = "ACDEFGHIKLMNPQRSTVWY"
LETTERS = ", ".join(f"('{a}')" for a in AA)


def norm(x: str) -> str:
    return f"trim(regexp_replace(replace({x}, chr(65279), ' '), '{WS}', ' ', 'g'))"


def clean(x: str) -> str:
    n = norm(f"cast({x} AS varchar)")
    return f"(CASE WHEN lower({n}) NOT IN ({TOKENS}) THEN {n} END)"


def seq(x: str) -> str:
    return rf"regexp_replace(upper({clean(x)}), '[\s\-]+', '', 'g')"


def pick(x: str, p: str, g: int) -> str:
    return f"regexp_extract({x}, '{p}', {g})"


def num(x: str, p: str, g: int) -> str:
    return f"try_cast({pick(x, p, g)} AS double)"


def unit_keep(x: str) -> str:
    for a, b in [("μ", "u"), ("µ", "u"), ("UM", "uM"), ("NM", "nM"), ("MM", "mM"), ("ug/ml", "ug/mL"), ("mg/ml", "mg/mL"), ("ng/ml", "ng/mL"), ("UG/ML", "ug/mL"), ("MG/ML", "mg/mL"), ("NG/ML", "ng/mL")]:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def factor(u: str) -> str:
    return f"(CASE {u} WHEN 'pM' THEN 1e-6 WHEN 'nM' THEN 1e-3 WHEN 'uM' THEN 1.0 WHEN 'mM' THEN 1e3 WHEN 'M' THEN 1e6 END)"


def r6(x: str) -> str:
    return f"round({x}, 6)"


N = r"([0-9]+(?:\.[0-9]+)?)"
RANGE, MASS = rf"^{N}\s*[-~]\s*{N}\s*(nM|uM|mM|M)$", rf"^([<>≤≥])?\s*{N}\s*(ng/mL|ug/mL|mg/mL)$"
LIMIT, EXACT = rf"^([<>≤≥])\s*{N}\s*(nM|uM|mM|M)$", rf"^{N}\s*(nM|uM|mM|M)$"
REL = "CASE WHEN regexp_matches(w, '^[<>≤≥]') THEN left(w, 1) ELSE '=' END"

ASSAY_SQL = ASSAY.replace("{div}", "//")


def parser(names: dict, extra_first: str, value_first: str, relation_first: str, unit_first: str, last: str, value_last: str, work: str, unit_last: str = "NULL") -> str:
    """Status, relation, value, low, high, unit and um of ``w``; the ``_first`` parts are CASE branches before the shared ones."""
    m = lambda p: f"regexp_matches(w, '{p}')"
    return rf"""SELECT ic50_raw,
      CASE WHEN t IS NULL THEN 'missing' {extra_first} WHEN {m(RANGE)} THEN 'range' WHEN {m(MASS)} THEN 'mass_unit' WHEN {m(LIMIT)} THEN '{names["limit"]}' WHEN {m(EXACT)} THEN '{names["exact"]}' {last} END AS status,
      CASE WHEN t IS NULL THEN NULL {relation_first} WHEN {m(RANGE)} THEN NULL WHEN {m(MASS)} OR {m(LIMIT)} THEN {REL} WHEN {m(EXACT)} THEN '=' END AS relation,
      CASE WHEN t IS NULL THEN NULL {value_first} WHEN {m(RANGE)} THEN NULL WHEN {m(MASS)} THEN {num("w", MASS, 2)} WHEN {m(LIMIT)} THEN {num("w", LIMIT, 2)} WHEN {m(EXACT)} THEN {num("w", EXACT, 1)} {value_last} END AS value,
      CASE WHEN t IS NULL THEN NULL {unit_first} WHEN {m(RANGE)} THEN {pick("w", RANGE, 3)} WHEN {m(MASS)} THEN {pick("w", MASS, 3)} WHEN {m(LIMIT)} THEN {pick("w", LIMIT, 3)} WHEN {m(EXACT)} THEN {pick("w", EXACT, 2)} ELSE {unit_last} END AS unit,
      CASE WHEN {m(LIMIT)} THEN {num("w", LIMIT, 2)} * {factor(pick("w", LIMIT, 3))} WHEN {m(EXACT)} THEN {num("w", EXACT, 1)} * {factor(pick("w", EXACT, 2))} END AS um,
      CASE WHEN {m(RANGE)} THEN {num("w", RANGE, 1)} END AS low, CASE WHEN {m(RANGE)} THEN {num("w", RANGE, 2)} END AS high,
      CASE WHEN {m(EXACT)} THEN 1 ELSE 0 END AS exact
    FROM (SELECT ic50_raw, {clean("ic50_raw")} AS t, {work} AS w FROM (SELECT DISTINCT ic50_raw FROM assay))"""


ODD = "regexp_matches(replace(w, ' ', ''), '(?:nM|uM|mM|M)/L')"
# RE2 has no backreference: both numbers are taken and compared.
TWICE = rf"(regexp_matches(w, '^{N}\s+{N}$') AND regexp_extract(w, '^{N}\s+{N}$', 1) = regexp_extract(w, '^{N}\s+{N}$', 2))"
AHTPDB = parser(
    {"limit": "threshold", "exact": "exact"},
    f"WHEN contains(w, '%') THEN 'percent' WHEN {ODD} THEN 'suspicious_unit' WHEN {TWICE} THEN 'dirty'",
    f"WHEN contains(w, '%') THEN {num('w', N, 1)} WHEN {ODD} THEN {num('w', N, 1)} WHEN {TWICE} THEN {num('w', N, 1)}",
    f"WHEN contains(w, '%') THEN NULL WHEN {ODD} THEN {REL} WHEN {TWICE} THEN NULL", f"WHEN contains(w, '%') OR {ODD} OR {TWICE} THEN t", "ELSE 'dirty'", "", unit_keep(clean("ic50_raw")), "t",
)
BIOPEP = parser(
    {"limit": "molar_threshold", "exact": "exact_molar"},
    f"WHEN regexp_matches(w, '^{N}$') THEN 'numeric_no_unit' WHEN contains(w, '%') THEN 'percent_like'", f"WHEN regexp_matches(w, '^{N}$') OR contains(w, '%') THEN {num('w', N, 1)}",
    f"WHEN regexp_matches(w, '^{N}$') THEN '=' WHEN contains(w, '%') THEN NULL", f"WHEN regexp_matches(w, '^{N}$') OR contains(w, '%') THEN NULL",
    f"WHEN regexp_matches(w, '{N}') THEN 'ambiguous_text' ELSE 'unparsed_text'", f"WHEN regexp_matches(w, '{N}') THEN {num('w', N, 1)}",
    unit_keep(rf"regexp_replace({clean('ic50_raw')}, '\s*\[[^\]]+\]\s*$', '')"),
)


def numbers(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, '[-+]?\d+(?:\.\d+)?'), lambda v: cast(v AS double))"


MBPDB = rf"""SELECT ic50_raw, CASE WHEN t IS NULL THEN 'missing' WHEN len(v) = 0 THEN 'unparsed_text' WHEN rel = '=' THEN 'exact_molar' ELSE 'molar_threshold' END AS status,
      CASE WHEN len(v) > 0 THEN rel END AS relation, list_median(v) AS value, CASE WHEN len(v) > 0 THEN 'uM' END AS unit, list_median(v) AS um, list_min(v) AS low, list_max(v) AS high
    FROM (SELECT ic50_raw, t, CASE WHEN regexp_matches(t, '^[<>≤≥]') THEN left(t, 1) ELSE '=' END AS rel, {numbers(r"regexp_replace(regexp_replace(t, '^\s*[<>≤≥]\s*', ''), '(^|\s)\d+\)\s*', '\1', 'g')")} AS v
          FROM (SELECT ic50_raw, {clean("ic50_raw")} AS t FROM (SELECT DISTINCT ic50_raw FROM assay)))"""


def fermfood(source: str, keys: str, mass: str, advanced: bool) -> str:
    work = clean("ic50_raw")
    low = f"lower({work})"
    for a, b in [("μ", "u"), ("µ", "u"), ("l-1", "/l"), (" ", "")]:
        low = f"replace({low}, '{a}', '{b}')"
    w = rf"regexp_replace({low}, '^[<>≤≥]+\s*', '')"
    w = rf"regexp_replace({w}, '(\d+(?:\.\d+)?)\s*±\s*\d+(?:\.\d+)?', '\1', 'g')"
    if advanced:
        w = rf"regexp_replace(replace({w}, 'mcg', 'ug'), '(\d+(?:\.\d+)?)\s*\+/-\s*\d+(?:\.\d+)?', '\1', 'g')"
    w = norm(rf"regexp_replace({w}, '\(([^)]*)\)', ' ', 'g')")
    end = "([^a-z]|$)" if advanced else r"([^\p{L}\p{N}_]|$)"
    per = "" if advanced else " OR contains(w, '{0}gperml')"
    mass_cases = " ".join(f"WHEN contains(w, '{p}g/ml'){per.format(p)} THEN '{p}g/ml'" for p in "mun")
    molar = " ".join(f"WHEN contains(w, '{p}mol/l') OR regexp_matches(w, '(^|[^a-z]){p}m{end}'){' OR contains(w, \'micromolar\')' if advanced and p == 'u' else ''} THEN '{p}M'" for p in "munp")
    return rf"""SELECT {keys}, CASE WHEN t IS NULL THEN 'missing' WHEN len(v) = 0 THEN 'unparsed_text' WHEN unit IS NULL THEN 'numeric_no_unit'
        WHEN per IS NOT NULL AND NOT coalesce(m > 0, false) THEN 'mass_concentration_needs_mass' WHEN rel = '=' THEN 'exact_molar' ELSE 'molar_threshold' END AS status,
      CASE WHEN t IS NOT NULL THEN rel END AS relation, med AS value, CASE WHEN len(v) > 0 THEN unit END AS unit,
      CASE WHEN len(v) = 0 OR unit IS NULL THEN NULL WHEN per IS NOT NULL THEN CASE WHEN m > 0 THEN med * (per / m) END ELSE med * {factor("unit")} END AS um
    FROM (SELECT *, list_median(v) AS med, CASE unit WHEN 'ng/ml' THEN 1.0 WHEN 'ug/ml' THEN 1e3 WHEN 'mg/ml' THEN 1e6 END AS per FROM (
      SELECT *, {numbers("w")} AS v, CASE WHEN regexp_matches(t, '^[<>≤≥]') THEN left(t, 1) ELSE '=' END AS rel, CASE {mass_cases} {molar} WHEN contains(w, 'mol/l') THEN 'M' END AS unit
      FROM (SELECT {keys}, {mass} AS m, {work} AS t, {w} AS w FROM {source})))"""


WITH_ASSAY = f"WITH assay AS ({ASSAY_SQL}), ahtpdb AS ({AHTPDB}), biopep AS ({BIOPEP}), mbpdb AS ({MBPDB}), fermfood AS ({fermfood('(SELECT DISTINCT ic50_raw FROM assay)', 'ic50_raw', 'cast(NULL AS double)', False)})"
RECORDS = WITH_ASSAY + f""", readings AS (
  SELECT 'AHTPDB' AS source_name, ic50_raw, status, relation, um FROM ahtpdb UNION ALL SELECT 'BIOPEP', ic50_raw, status, relation, um FROM biopep
  UNION ALL SELECT 'MBPDB', ic50_raw, status, relation, um FROM mbpdb UNION ALL SELECT 'FermFooDb', ic50_raw, status, relation, um FROM fermfood),
records AS (SELECT record_id, source_name, sequence, length(sequence) AS peptide_length, assay, method, model, species, year, relation, status, um FROM assay LEFT JOIN readings USING (source_name, ic50_raw)
  WHERE (source_name <> 'AHTPDB' OR regexp_matches(sequence, '^[{AA}]+$')) AND sequence IS NOT NULL AND um IS NOT NULL AND status IN ('exact', 'threshold', 'exact_molar', 'molar_threshold'))"""
LEVEL = RECORDS + """, level0 AS (SELECT sequence, min(peptide_length) AS peptide_length, count(DISTINCT source_name) AS source_count, string_agg(DISTINCT source_name, ' | ' ORDER BY source_name) AS source_name_set,
  count(*) AS record_count_total, count(*) FILTER (source_name = 'AHTPDB') AS record_count_ahtpdb, count(*) FILTER (source_name = 'BIOPEP') AS record_count_biopep, count(*) FILTER (source_name = 'MBPDB') AS record_count_mbpdb,
  count(*) FILTER (source_name = 'FermFooDb') AS record_count_fermfooddb, string_agg(DISTINCT relation, ' | ' ORDER BY relation) AS ic50_relation_set, string_agg(DISTINCT status, ' | ' ORDER BY status) AS ic50_status_set,
  string_agg(DISTINCT species, ' | ' ORDER BY species) AS species_set, min(um) AS ic50_uM_min, max(um) AS ic50_uM_max, round(avg(um), 9) AS ic50_uM_mean, round(median(um), 6) AS ic50_uM_median,
  min(year) AS bibliographic_year_min, max(year) AS bibliographic_year_max, round(CASE WHEN min(um) > 0 THEN max(um) / min(um) END, 6) AS ic50_spread_ratio_max_min FROM records GROUP BY sequence),
level AS (SELECT *, cast(source_count >= 2 AS int) AS cross_source_overlap_flag, CASE WHEN record_count_total <= 1 THEN 'singleton' WHEN ic50_spread_ratio_max_min IS NULL THEN 'unknown'
  WHEN source_count >= 2 AND ic50_spread_ratio_max_min <= 10 THEN 'cross_source_consistent' WHEN ic50_spread_ratio_max_min <= 10 THEN 'within_range_consistent' ELSE 'conflicting' END AS stability_flag FROM level0)"""
RATIO = "ic50_spread_ratio_max_min"
CONSENSUS_COLS = f"""CASE WHEN source_count >= 3 AND ok THEN 'Tier A' WHEN source_count = 2 AND ok THEN 'Tier B' WHEN source_count = 1 AND med IS NOT NULL THEN 'Tier C'
  WHEN source_count >= 2 AND stability_flag = 'conflicting' THEN 'Tier D' ELSE 'Tier E' END AS consensus_tier,
  cast(least(source_count, 4) * 20 + least(record_count_total, 10) * 2 + CASE stability_flag WHEN 'cross_source_consistent' THEN 25 WHEN 'within_range_consistent' THEN 18 WHEN 'singleton' THEN 8 WHEN 'unknown' THEN 3 WHEN 'conflicting' THEN -20 ELSE 0 END
  + CASE WHEN x <= 3 THEN 15 WHEN x <= 10 THEN 8 WHEN x <= 30 THEN -5 WHEN x IS NOT NULL THEN -12 ELSE 0 END AS int) AS consensus_score"""
OK = "coalesce(stability_flag IN ('cross_source_consistent', 'within_range_consistent') AND x <= 10 AND med IS NOT NULL, false) AS ok"
CONSENSUS = LEVEL + f", cons AS (SELECT *, {CONSENSUS_COLS} FROM (SELECT *, {OK} FROM (SELECT *, {RATIO} AS x, ic50_uM_median AS med FROM level)))"
FLAGGED = LEVEL + f""", flagged AS (SELECT *, {RATIO} AS x, CASE stability_flag WHEN 'cross_source_consistent' THEN 'Tier_A' WHEN 'within_range_consistent' THEN 'Tier_B' WHEN 'singleton' THEN 'Tier_C' ELSE 'Tier_X' END AS consensus_tier FROM level)"""


def sig6(x: str) -> str:
    return f"cast(printf('%.6g', {x}) AS double)"


def sorted_set(x: str) -> str:
    return f"coalesce(string_agg(DISTINCT {x}, ' | ' ORDER BY {x}), '')"


HIGHCONF = RECORDS + f""", hc0 AS (SELECT sequence, count(*) AS record_count, list_sort(list(DISTINCT um)) AS v, {", ".join(f"count(DISTINCT {c}) AS {n}_count, {sorted_set(c)} AS {n}_list" for n, c in (("source", "source_name"), ("assay", "assay"), ("method", "method"), ("model", "model")))}, {sorted_set("record_id")} AS record_id_list
  FROM records WHERE status IN ('exact', 'exact_molar') AND peptide_length IN (2, 3) AND regexp_matches(sequence, '^[{AA}]+$') GROUP BY sequence),
hc1 AS (SELECT *, list_median(v) AS m, v[1] AS low, v[-1] AS high FROM hc0),
hc AS (SELECT sequence, length(sequence) AS peptide_length, record_count, len(v) AS n_unique, {sig6("low")} AS um_min, {sig6("high")} AS um_max, CASE WHEN low > 0 THEN {sig6("exp(list_avg(list_transform(v, lambda a: ln(a))))")} END AS um_geomean,
  CASE WHEN len(v) = 1 THEN 'stable' WHEN low <= 0 THEN 'undetermined' WHEN high / low <= 3 THEN 'stable' WHEN high / low <= 10 THEN 'condition-sensitive' ELSE 'high-conflict' END AS stability_class,
  source_count, assay_count, method_count, model_count, source_list, assay_list, method_list, model_list, record_id_list, {sig6("m")} AS um_median, CASE WHEN m > 0 THEN {sig6("log10(m)")} END AS log10_median,
  CASE WHEN len(v) = 1 THEN 1.0::double WHEN low > 0 THEN {sig6("high / low")} END AS fold, CASE WHEN {sig6("m")} <= 50 THEN 'strong' WHEN {sig6("m")} <= 200 THEN 'medium' ELSE 'weak' END AS activity_tier FROM hc1),
st AS (SELECT *, CASE peptide_length WHEN 2 THEN 'di' ELSE 'tri' END AS type FROM hc WHERE stability_class = 'stable')"""
EXACT_VALUES = WITH_ASSAY + f""", ev AS (SELECT sequence, count(*) AS dup_count, count(DISTINCT v) AS n_values, {sorted_set("v")} AS v_list, count(DISTINCT source_name) AS n_sources, {sorted_set("source_name")} AS sources_list, count(DISTINCT assay) AS n_assays, {sorted_set("assay")} AS assays_list, {sorted_set("record_id")} AS ids_list
  FROM (SELECT assay.*, CASE WHEN exact = 1 AND um IS NOT NULL THEN printf('%.6g', um) END AS v FROM assay LEFT JOIN ahtpdb USING (ic50_raw)) GROUP BY sequence HAVING count(DISTINCT v) >= 2)"""


def fmdb(x: str) -> str:
    return rf"try_cast(regexp_extract({x}, '(?i)fmdb[\s_\-\x{{A0}}\x{{200B}}\x{{200C}}\x{{200D}}\x{{2060}}\x{{FEFF}}\x{{AD}}]*([0-9]+)', 1) AS bigint)"


def rich(cols: list[str]) -> str:
    return " + ".join(f"cast({clean(c)} IS NOT NULL AS int)" for c in cols)


RICH = ["ph", "temperature", "incubation_time", "activity", "mass", "mz_ratio", "ic50_raw"]
LISTS = f"WITH l AS (SELECT *, {fmdb('fmdb_id')} AS num FROM fermfoodb_ace_list), d AS (SELECT *, {fmdb('fmdb_id')} AS num FROM fermfoodb_ace_detail)"
RICHEST = LISTS + f", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY num ORDER BY {rich(RICH)} DESC, row_id) AS rn, count(*) OVER (PARTITION BY num) AS dup_count FROM d WHERE num IS NOT NULL) WHERE rn = 1)"


def dedupe(t: str, order: str) -> str:
    return f"SELECT num, row_id, ph, mass, n AS dup_count FROM (SELECT *, row_number() OVER (PARTITION BY num ORDER BY row_id {order}) AS rn, count(*) OVER (PARTITION BY num) AS n FROM {t} WHERE num IS NOT NULL) WHERE rn = 1"


PEPTIDES = f"WITH s AS (SELECT row_id, {seq('peptide_sequence')} AS seq FROM fermfoodb_ace_detail), p AS (SELECT DISTINCT seq FROM s WHERE regexp_matches(seq, '^[{AA}]+$'))"
TABLE = "(CASE r " + " ".join(f"WHEN '{a}' THEN {m}" for a, m in RESIDUE_MASS.items()) + " ELSE 0 END)"
HYDRO = "(CASE r " + " ".join(f"WHEN '{a}' THEN {m}" for a, m in features.HYDRO.items()) + " END)"
FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_float(x: str) -> str:
    t = f"replace(trim({x}), ',', '')"
    return f"(CASE WHEN regexp_matches({t}, '{FLOAT}') THEN try_cast({t} AS double) END)"


def first_number(x: str) -> str:
    return rf"try_cast(nullif(regexp_extract({x}, '[-+]?\d+(?:\.\d+)?', 0), '') AS double)"


def url_part(x: str, i: int) -> str:
    return rf"regexp_extract(trim({x}), '^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?', {i})"


def slug(x: str) -> str:
    return f"left(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 60)"


def safe_name(x: str) -> str:
    path = rf"replace(regexp_replace({url_part(x, 3)}, '^/+|/+$', '', 'g'), '/', '_')"
    return rf"'page_' || left(regexp_replace(CASE WHEN {path} = '' THEN 'root' ELSE {path} END, '[^A-Za-z0-9._\-]+', '_', 'g'), 60) || '_' || left(md5({x}), 12)"


def url_pairs(x: str) -> str:
    """Sorted ``key chr(1) value`` texts of a query; chr(1) sorts before every character of a key."""
    one = "url_decode(replace(regexp_extract(a, '^[^=]*'), '+', ' ')) || chr(1) || url_decode(replace(CASE WHEN contains(a, '=') THEN regexp_replace(a, '^[^=]*=', '') ELSE '' END, '+', ' '))"
    return f"list_sort(list_transform(list_filter(string_split({url_part(x, 4)}, '&'), lambda a: a <> ''), lambda a: {one}))"


def url(x: str) -> str:
    scheme, host = f"lower({url_part(x, 1)})", f"lower({url_part(x, 2)})"
    path = f"regexp_replace(regexp_replace({url_part(x, 3)}, ';[^/]*$', ''), '/+', '/', 'g')"
    query = f"replace(array_to_string({url_pairs(x)}, '&'), chr(1), '=')"
    return f"(CASE WHEN {scheme} <> '' THEN {scheme} || ':' ELSE '' END || CASE WHEN {host} <> '' THEN '//' || {host} ELSE '' END || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END)"


def page_class(u: str, title: str, text: str) -> str:
    """Scores of a page, with the words and keys of both kinds."""
    blob = f"lower(coalesce({u}, '') || ' ' || coalesce({title}, '') || ' ' || coalesce({text}, ''))"
    keys = f"list_transform({url_pairs(f'coalesce({u}, chr(32))')}, lambda a: string_split(a, chr(1))[1])"
    detail = f"len(list_filter(['detail', 'peptide', 'peptide sequence', 'ic50', 'assay', 'matrix', 'culture', 'protein', 'doi', 'entry', 'record'], lambda w: contains({blob}, w))) + CASE WHEN list_has_any({keys}, ['id', 'seqid', 'pid', 'detail']) THEN 2 ELSE 0 END"
    listed = f"len(list_filter(['search', 'advance', 'browse', 'activity', 'result', 'results', 'page=', 'list', 'table', 'hydrolysis', 'experiment'], lambda w: contains({blob}, w))) + CASE WHEN list_has_any({keys}, ['page', 'search', 'act', 'activity', 'keyword', 'type']) THEN 2 ELSE 0 END"
    return f"(CASE WHEN {detail} > {listed} THEN 'detail_like' WHEN {listed} > {detail} THEN 'list_like' ELSE 'unknown' END)"


def section(start: str, ends: list[str]) -> str:
    return clean(f"regexp_extract(text, '(?is){start}(.*?)(?:{'|'.join(ends)}|$)', 1)")


def hits(words: list[str]) -> str:
    return f"list_filter([{', '.join(repr(w) for w in words)}], lambda w: contains(lower(coalesce(text, '')), w))"


LABELS = ["Entry:", "Name:", "Sequence:", "Number of residues:", "Monoisotopic mass:", "IC50 :", "Activity:", "Source:", "Assay:", r"Additional information:"]
YEARS = r"list_transform(regexp_extract_all(coalesce({0}, ''), '\b((?:19|20)\d{{2}})\b', 1), lambda y: cast(y AS int))"
PARSED = f"status, relation, {r6('value')} AS value, unit, {r6('um')} AS um"
FOLD_BINS = "CASE WHEN fold IS NULL THEN 'missing' WHEN fold <= 1 THEN '1' WHEN fold <= 1.5 THEN '(1,1.5]' WHEN fold <= 2 THEN '(1.5,2]' WHEN fold <= 3 THEN '(2,3]' WHEN fold <= 5 THEN '(3,5]' WHEN fold <= 10 THEN '(5,10]' ELSE '>10' END"


def shares(rows: str, groups: dict[str, list[str]]) -> str:
    """Counts and shares of ``rows`` (groups..., residue) over the alphabet and the fixed groups, zeros included."""
    on = ", ".join(groups)
    grid = " CROSS JOIN ".join(f"(VALUES {', '.join(f'({v!r})' for v in vs)}) AS g_{c}({c})" for c, vs in groups.items())
    return f"""r AS ({rows}), n AS (SELECT {on}, residue, count(*) AS n FROM r GROUP BY ALL), f AS (SELECT {on}, residue, coalesce(n, 0) AS n FROM {grid} CROSS JOIN (VALUES {LETTERS}) AS l(residue) LEFT JOIN n USING ({on}, residue)),
    shown AS (SELECT *, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY {on}), 0), 0), 6) AS share FROM f)"""


def enrich(rows: str, group: str, values: list[str]) -> str:
    """Enrichment of ``rows`` (group, residue, strong) over the alphabet and the fixed groups: log2 of smoothed shares."""
    return f"""r AS ({rows}), n AS (SELECT {group}, residue, count(*) AS n_all, sum(strong) AS n_strong FROM r GROUP BY ALL),
    f AS (SELECT {group}, residue, cast(coalesce(n_all, 0) AS bigint) AS n_all, cast(coalesce(n_strong, 0) AS bigint) AS n_strong FROM (VALUES {", ".join(f"({v!r})" for v in values)}) AS g({group}) CROSS JOIN (VALUES {LETTERS}) AS l(residue) LEFT JOIN n USING ({group}, residue)),
    t AS (SELECT *, sum(n_all) OVER (PARTITION BY {group}) AS ta, sum(n_strong) OVER (PARTITION BY {group}) AS ts FROM f),
    u AS (SELECT *, coalesce(n_all / nullif(ta, 0), 0) AS fa, coalesce(n_strong / nullif(ts, 0), 0) AS fs FROM t),
    enriched AS (SELECT {group}, residue, n_all, n_strong, round(fa, 6) AS freq_all, round(fs, 6) AS freq_strong, round(fs - fa, 6) AS diff, round(log2(((n_strong + 0.5) / (ts + 0.5 * 20)) / ((n_all + 0.5) / (ta + 0.5 * 20))), 6) AS log2fc FROM u)"""


PLACES = "SELECT type || i AS place, substr(sequence, cast(i AS int), 1) AS residue, cast(activity_tier = 'strong' AS int) AS strong FROM st, unnest(range(1, length(sequence) + 1)) AS u(i)"
PLACE_NAMES = ["di1", "di2", "tri1", "tri2", "tri3"]
ENDS = "SELECT 'N' AS term, type, left(sequence, 1) AS residue, cast(activity_tier = 'strong' AS int) AS strong FROM st UNION ALL SELECT 'C', type, right(sequence, 1), cast(activity_tier = 'strong' AS int) FROM st"
END_GROUPS = f"SELECT term, residue, 'all-' || type AS grp FROM ({ENDS}) UNION ALL SELECT term, residue, 'strong-' || type FROM ({ENDS}) WHERE strong = 1"
LIST_COLUMNS = ["row_id", "list_page_no", "list_page_url", "row_no_on_page", "fmdb_id", "detail_url", "pubmed_id", "title", "peptide_sequence", "length_of_peptide", "food_matrix", "protein", "ph", "temperature", "incubation_time", "activity", "experiment", "model", "assay_for_activity_measurement", "culture", "hydrolysis", "method_of_analysis", "mz_ratio", "mass", "ic50_raw", "crawled_at", "withdrawn_at"]
BARE = r"(?i)\bIC50\s*:?\s*([<>≤≥]?)\s*" + N + r"\b"
UNIT = r"(µM|μM|uM|nM|mM|M|micromole|micromolar)\b"
LABEL, SENTENCE = rf"(?i)\bIC50\s*:?\s*([<>≤≥]?)\s*{N}\s*{UNIT}", rf"(?i)\bIC50\b.*?\b(?:was|is|of)\s*([<>≤≥]?)\s*{N}\s*{UNIT}"


def from_text() -> str:
    def u(p):
        return f"CASE lower(translate({pick('t', p, 3)}, 'µμ', 'uu')) WHEN 'um' THEN 'uM' WHEN 'micromole' THEN 'uM' WHEN 'micromolar' THEN 'uM' WHEN 'nm' THEN 'nM' WHEN 'mm' THEN 'mM' WHEN 'm' THEN 'M' END"

    return f"""WITH x AS (SELECT doc_id, t, k, CASE k WHEN 1 THEN {num("t", LABEL, 2)} WHEN 2 THEN {num("t", SENTENCE, 2)} WHEN 3 THEN {num("t", BARE, 2)} END AS value,
      CASE k WHEN 1 THEN {u(LABEL)} WHEN 2 THEN {u(SENTENCE)} END AS unit, CASE k WHEN 1 THEN coalesce(nullif({pick("t", LABEL, 1)}, ''), '=') WHEN 2 THEN coalesce(nullif({pick("t", SENTENCE, 1)}, ''), '=') WHEN 3 THEN coalesce(nullif({pick("t", BARE, 1)}, ''), '=') END AS relation
    FROM (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN regexp_matches(coalesce(text, ''), '{LABEL}') THEN 1 WHEN regexp_matches(coalesce(text, ''), '{SENTENCE}') THEN 2 WHEN regexp_matches(coalesce(text, ''), '{BARE}') THEN 3 ELSE 4 END AS k FROM documents))
    SELECT doc_id, CASE WHEN k = 4 THEN 'missing' WHEN k = 3 THEN 'numeric_no_unit' WHEN relation = '=' THEN 'exact_molar' ELSE 'molar_threshold' END AS status, relation, {r6("value")} AS value, unit, {r6(f"value * {factor('unit')}")} AS um FROM x"""


def first_clean(*xs: str) -> str:
    return f"coalesce({', '.join(clean(x) for x in xs)})"


# What a page is made of: its entries, empty where null.
ENTRIES = "WITH e AS (SELECT list_page_url, row_id, coalesce(fmdb_id, '') AS fmdb_id, coalesce(peptide_sequence, '') AS peptide_sequence, coalesce(ic50_raw, '') AS ic50_raw, coalesce(detail_url, '') AS detail_url FROM fermfoodb_ace_list)"


def squeezed(x: str) -> str:
    """White space as a reader of markup sees it."""
    return f"trim(regexp_replace({x}, '{WS.replace('{FEFF}', '')}', ' ', 'g'))"


def scale(table: dict[str, float]) -> str:
    return "(CASE r " + " ".join(f"WHEN '{a}' THEN {v}::double" for a, v in table.items()) + " END)"


def _fusion() -> str:
    """Composition, then per scale moments, autocorrelations and the spectrum of the closed-form transform, then the length."""
    mean = "(list_sum({0}) / len({0}))"

    def correlation(x: str, lag: int) -> str:
        n = f"(len({x}) - {lag})"
        a, b = f"{x}[1:{n}]", f"{x}[{lag + 1}:]"
        ca, cb = (f"list_transform({v}, lambda q: q - {mean.format(v)})" for v in (a, b))
        va, vb = (f"list_sum(list_transform({c}, lambda q: q * q))" for c in (ca, cb))
        cov = f"list_sum(list_transform(list_zip({ca}, {cb}), lambda q: q[1] * q[2]))"
        return f"CASE WHEN {n} <= 0 THEN 0.0 WHEN {va} / {n} < 1e-24 OR {vb} / {n} < 1e-24 THEN 0.0 ELSE {cov} / sqrt({va} * {vb}) END"

    parts, columns = [], []
    for k, t in features.SCALES.items():
        columns.append(f"list_transform(string_split(seq, ''), lambda r: {scale(t)}) AS x_{k}")
        x, m = f"x_{k}", f"m_{k}"
        parts.append(
            f"[{mean.format(x)}, sqrt(list_sum(list_transform({x}, lambda q: (q - {mean.format(x)}) * (q - {mean.format(x)}))) / len({x})), list_min({x}), list_max({x}), list_sum(list_transform({x}, lambda q: q * q)) / len({x}), {correlation(x, 1)}, {correlation(x, 2)}, "
            f"list_sum(list_transform({m}, lambda q: q * q)), CASE WHEN list_sum({m}) < 1e-12 THEN 0.0 ELSE list_sum(list_transform({m}, lambda q, i: q * (i - 1))) / list_sum({m}) END, (list_position({m}, list_max({m})) - 1) / greatest(len({m}) - 1, 1)]"
        )
    spectra = ", ".join(
        f"list_transform(range(0, len(x_{k}) // 2 + 1), lambda f: sqrt(pow(list_sum(list_transform(x_{k}, lambda q, i: q * cos(2 * pi() * f * (i - 1) / len(x_{k})))), 2) + pow(list_sum(list_transform(x_{k}, lambda q, i: q * sin(2 * pi() * f * (i - 1) / len(x_{k})))), 2))) AS m_{k}"
        for k in features.SCALES
    )
    whole = "list_concat(" * (len(parts) + 1) + f"list_concat(list_transform(string_split('{AA}', ''), lambda a: (length(seq) - length(replace(seq, a, ''))) / length(seq)), [length(seq)::double]), " + "), ".join(parts) + "), [length(seq)::double])"
    return f"{PEPTIDES}, x AS (SELECT seq, {', '.join(columns)} FROM p), m AS (SELECT *, {spectra} FROM x) SELECT seq, unnest(range(0, 62))::int AS i, round(unnest({whole}), 6) AS x FROM m"


FUSION = _fusion()
OLD = "(SELECT {}, ic50_raw, mass_da, ic50_parse_status AS old_status, ic50_relation AS old_relation, ic50_unit AS old_unit, ic50_value AS old_value, CASE WHEN isfinite(ic50_uM) THEN ic50_uM END AS old_um FROM {})"

ORACLES = {
    "ic50_ahtpdb": f"{WITH_ASSAY} SELECT l_orderkey, l_linenumber, {PARSED}, {r6('low')} AS low, {r6('high')} AS high, exact FROM assay LEFT JOIN ahtpdb USING (ic50_raw)",
    "ic50_biopep": f"{WITH_ASSAY} SELECT l_orderkey, l_linenumber, {PARSED} FROM assay LEFT JOIN biopep USING (ic50_raw)",
    "ic50_mbpdb": f"{WITH_ASSAY} SELECT l_orderkey, l_linenumber, {PARSED}, {r6('low')} AS low, {r6('high')} AS high FROM assay LEFT JOIN mbpdb USING (ic50_raw)",
    "ic50_fermfood": f"SELECT row_id, {PARSED} FROM ({fermfood('fermfoodb_ace_master_clean', 'row_id', 'mass_da', False)})",
    "ic50_fermfood_advanced": f"SELECT row_id, {PARSED} FROM ({fermfood('fermfoodb_ace_master_clean', 'row_id', 'mass_da', True)})",
    "ic50_from_text": from_text(),
    "ic50_type_distribution": f"{WITH_ASSAY} SELECT status, n, round(100 * n / sum(n) OVER (), 2) AS pct FROM (SELECT status, count(*) AS n FROM assay JOIN ahtpdb USING (ic50_raw) GROUP BY status)",
    "unit_mass_to_um": f"""{WITH_ASSAY}, j AS (SELECT l_partkey, CASE WHEN relation = '=' AND value > 0 AND molwt > 0 THEN CASE lower(unit) WHEN 'mg/ml' THEN value * 1e6 / molwt WHEN 'ug/ml' THEN value * 1e3 / molwt END END AS um
      FROM assay JOIN ahtpdb USING (ic50_raw) LEFT JOIN (SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS molwt FROM part) ON p_partkey = l_partkey WHERE status = 'mass_unit')
      SELECT l_partkey, count(*) AS n, count(um) AS n_converted, round(sum(um), 3) AS um_sum FROM j GROUP BY l_partkey""",
    "context_rescue": f"""WITH t AS (SELECT row_id, {seq('sequence')} AS seq, {clean('ic50_parse_status')} AS st, {clean('ic50_raw')} AS raw, CASE WHEN isfinite(ic50_uM) THEN ic50_uM END AS um FROM fermfoodb_ace_master_rescued),
      c AS (SELECT seq, count(*) AS n_context, round(median(um), 6) AS context_median, round(min(um), 6) AS context_min, round(max(um), 6) AS context_max FROM t WHERE seq IS NOT NULL AND st IN ('exact_molar', 'molar_threshold') AND um IS NOT NULL GROUP BY seq)
      SELECT row_id, seq, CASE WHEN n_context >= 2 THEN round(list_median({numbers("raw")}), 6) END AS rescued_um, n_context, context_median, context_min, context_max FROM t LEFT JOIN c USING (seq) WHERE st = 'numeric_no_unit'""",
    "clean_text_tokens": "SELECT row_id, " + ", ".join(f"{clean(c)} AS {c}" for c in ("ph", "temperature", "incubation_time", "culture")) + " FROM fermfoodb_ace_list",
    "year_extract": f"""SELECT * FROM (SELECT doc_id, list_max({YEARS.format('text')}) AS latest, coalesce(list_min({YEARS.format('text')}), list_min({YEARS.format('pubmed_id')})) AS earliest,
      CASE WHEN length(y) = 4 AND cast(y AS int) BETWEEN 1800 AND 2100 THEN cast(y AS int) END AS digits FROM (SELECT *, left(regexp_replace({clean('pubmed_id')}, '\\D', '', 'g'), 4) AS y FROM documents)) WHERE latest IS NOT NULL OR earliest IS NOT NULL OR digits IS NOT NULL""",
    "number_coercion": f"SELECT row_id, {r6(to_float('ph'))} AS ph, {r6(to_float('mass'))} AS mass, CASE WHEN abs(n - round(n)) < 1e-9 THEN cast(round(n) AS bigint) END AS len FROM (SELECT *, {to_float('length_of_peptide')} AS n FROM fermfoodb_ace_detail)",
    "mass_from_text": f"SELECT row_id, {r6(f"coalesce({first_number(clean('mass'))}, {first_number(clean('mz_ratio'))})")} AS mass_da FROM fermfoodb_ace_detail",
    "six_digits": "SELECT row_id, round(round(m * s) / s, 9) AS sig6 FROM (SELECT row_id, ic50_uM_mean AS m, pow(10.0, 5 - floor(log10(abs(ic50_uM_mean)))) AS s FROM ace_short_2_3_merged_sequence_level_v0_3 WHERE ic50_uM_mean > 0 AND NOT isnan(ic50_uM_mean))",
    "canonical_sequence_filter": f"SELECT row_id, seq, length(seq) AS len FROM (SELECT row_id, {seq('peptide_sequence')} AS seq FROM fermfoodb_ace_detail) WHERE regexp_matches(seq, '^[{AA}]+$')",
    "terminal_residues": f"{PEPTIDES} SELECT row_id, left(seq, 1) AS n_term, right(seq, 1) AS c_term, reverse(seq) AS rev, cast(length(seq) = 2 AS int) AS is_di, cast(length(seq) = 3 AS int) AS is_tri FROM s WHERE regexp_matches(seq, '^[{AA}]+$')",
    "natural_key": f"SELECT row_id, concat_ws('_', 'FMDB', {slug(clean('protein'))}, {seq('peptide_sequence')}, {slug(clean('ph'))}) AS key FROM fermfoodb_ace_list",
    "safe_file_name": f"SELECT row_id, {safe_name('detail_url')} AS name FROM fermfoodb_ace_list",
    "url_canonical": f"SELECT row_id, {url('list_page_url')} AS list_url, {url('detail_url')} AS detail_url FROM fermfoodb_ace_list",
    "page_keyword_hits": f"SELECT doc_id, array_to_string({hits(['peptide', 'activity', 'ic50', 'function', 'matrix', 'culture', 'protein', 'fermentation', 'hydrolysis'])}, ' | ') AS hits FROM documents",
    "page_class": f"SELECT doc_id, {page_class('NULL', 'NULL', 'text')} AS page_class FROM documents",
    "page_class_of_urls": f"SELECT row_id, {page_class('list_page_url', 'title', 'experiment')} AS list_page, {page_class('detail_url', 'title', 'ic50_raw')} AS detail_page FROM fermfoodb_ace_list",
    "section_extract": f"SELECT doc_id, {section('Activity:', LABELS)} AS activity, {section('Assay:', LABELS)} AS assay, {section('Additional information:', LABELS)} AS information FROM documents WHERE doc_kind = 'card'",
    "notes_edit": """SELECT log_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), '; ') AS notes FROM (SELECT log_id, list_concat(list_filter(list_transform(string_split(coalesce(notes, ''), ';'), lambda a: trim(a)), lambda a: a <> '' AND a <> 'ic50_needs_manual_review'),
      list_filter([CASE WHEN ic50_uM IS NULL THEN 'um_open' END, 'reviewed'], lambda a: a IS NOT NULL)) AS w FROM fermfoodb_ace_parse_log)""",
    "compose_labels": f"""SELECT row_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' | ') AS label, CASE WHEN m IS NOT NULL THEN v || ' [' || m || ']' ELSE v END AS composed
      FROM (SELECT row_id, list_filter([{clean('activity')}, {clean('experiment')}, {clean('activity')}, {clean('model')}], lambda a: a IS NOT NULL) AS w, {clean('ic50_raw')} AS v, {clean('assay_for_activity_measurement')} AS m FROM fermfoodb_ace_detail)""",
    "keep_first_dedupe": f"{LISTS} {dedupe('l', '')}",
    "keep_last_dedupe": f"{LISTS} {dedupe('d', 'DESC')}",
    "richest_row_dedupe": f"{RICHEST} SELECT num, row_id, dup_count FROM best",
    "left_backfill": f"{LISTS}, a AS ({dedupe('l', '').replace(' WHERE num IS NOT NULL', '')}), b AS ({dedupe('d', '')}) SELECT a.num, {first_clean('a.ph', 'b.ph')} AS ph, {first_clean('a.mass', 'b.mass')} AS mass FROM a LEFT JOIN b USING (num)",
    "full_outer_provenance": f"""{LISTS}, a AS (SELECT num, max(row_id) AS list_row FROM l WHERE num IS NOT NULL GROUP BY num), b AS (SELECT num, max(row_id) AS detail_row FROM d WHERE num IS NOT NULL GROUP BY num)
      SELECT num, list_row, detail_row, CASE WHEN list_row IS NOT NULL AND detail_row IS NOT NULL THEN 'list+detail' WHEN list_row IS NOT NULL THEN 'list_only' ELSE 'detail_only' END AS merge_source FROM a FULL JOIN b USING (num)""",
    "list_detail_fusion": f"{RICHEST} SELECT l.row_id, {first_clean('l.detail_url', 'b.detail_url')} AS detail_url, " + ", ".join(f"{first_clean(f'b.{c}', f'l.{c}')} AS {c}" for c in ("activity", "mass", "ic50_raw")) + " FROM l LEFT JOIN best b ON b.num = l.num",
    "backfill_flags": f"{RICHEST} SELECT l.row_id, " + ", ".join(f"{first_clean(f'l.{c}', f'b.{c}')} AS {c}, cast({clean(f'l.{c}')} IS NULL AND {clean(f'b.{c}')} IS NOT NULL AS int) AS {c}_filled" for c in ("ph", "temperature")) + " FROM l LEFT JOIN best b ON b.num = l.num",
    "backfill_gain": f"{RICHEST} SELECT count(*) AS total, " + ", ".join(f"cast(sum(cast({clean(f'l.{c}')} IS NULL AND {clean(f'b.{c}')} IS NOT NULL AS int)) AS bigint) AS {c}_gain, count({first_clean(f'l.{c}', f'b.{c}')}) AS {c}_after" for c in ("ph", "temperature")) + " FROM l LEFT JOIN best b ON b.num = l.num",
    "status_before_after": f"""WITH p AS ({fermfood('fermfoodb_ace_master_clean', 'row_id, ic50_parse_status', 'mass_da', False)}), a AS (SELECT coalesce({clean('ic50_parse_status')}, 'none') AS status, count(*) AS n FROM p GROUP BY 1),
      b AS (SELECT status, count(*) AS n FROM p GROUP BY 1) SELECT status, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after FROM a FULL JOIN b USING (status)""",
    "status_upgrade": f"""WITH p AS ({fermfood(OLD.format('row_id', 'fermfoodb_ace_master_clean'), 'row_id, old_status, old_relation, old_unit, old_value, old_um', 'mass_da', True)}),
      q AS (SELECT *, (status IN ('exact_molar', 'molar_threshold') AND um IS NOT NULL) AND (NOT coalesce({clean('old_status')} IN ('exact_molar', 'molar_threshold') AND old_um IS NOT NULL, false) OR um <> old_um) AS up FROM p)
      SELECT row_id, cast(up AS int) AS changed, CASE WHEN up THEN status ELSE old_status END AS status, CASE WHEN up THEN relation ELSE old_relation END AS relation, CASE WHEN up THEN unit ELSE old_unit END AS unit,
      round(CASE WHEN up THEN value WHEN isfinite(old_value) THEN old_value END, 6) AS value, round(CASE WHEN up THEN um ELSE old_um END, 6) AS um FROM q""",
    "detail_text_upgrade": f"""WITH p AS ({fermfood(OLD.format('log_id', 'fermfoodb_ace_parse_log'), 'log_id, old_status, old_unit, old_um', 'mass_da', True)})
      SELECT log_id, status, round(um, 6) AS um FROM p WHERE status IN ('exact_molar', 'molar_threshold') AND (coalesce({clean('old_status')}, '') IN ('', 'missing', 'numeric_no_unit', 'ambiguous_text', 'unparsed_text', 'percent_like', 'range', 'mass_unit') OR old_um IS NULL OR ({clean('old_unit')} IS NULL AND unit IS NOT NULL))""",
    "append_unique": """WITH o AS (SELECT 'k' || (s_suppkey * 2) AS source_id, s_suppkey + 1 AS n FROM supplier), f AS (SELECT 'k' || n_nationkey AS source_id, n_name FROM nation WHERE 'k' || n_nationkey NOT IN (SELECT source_id FROM o))
      SELECT source_id, n_name, printf('src_%03d', (SELECT max(n) FROM o) + row_number() OVER (ORDER BY source_id)) AS catalog_id FROM f""",
    "merge_union_sources": f"{RECORDS} SELECT source_name, status, relation, count(*) AS n, round(sum(um), 3) AS um_sum FROM records GROUP BY ALL",
    "sequence_level": f"{LEVEL} SELECT * FROM level",
    "stability_flag": f"{LEVEL} SELECT stability_flag, count(*) AS n FROM level GROUP BY 1",
    "per_source_sequence_level": f"""{RECORDS}, g AS (SELECT source_name, sequence, count(*) AS n, min(um) AS um_min, max(um) AS um_max, round(median(um), 6) AS um_median, round(CASE WHEN min(um) > 0 THEN max(um) / min(um) END, 6) AS ratio FROM records GROUP BY 1, 2)
      SELECT *, CASE WHEN n <= 1 THEN 'singleton' WHEN ratio IS NULL THEN 'unknown' WHEN ratio <= 10 THEN 'within_range_consistent' ELSE 'conflicting' END AS flag FROM g""",
    "consensus_tier": f"{CONSENSUS} SELECT sequence, peptide_length, source_count, record_count_total, ic50_uM_median, {RATIO}, stability_flag, consensus_tier, consensus_score, cast(consensus_tier IN ('Tier A', 'Tier B') AS int) AS high_confidence_flag, cast(consensus_tier = 'Tier D' AS int) AS conflict_flag, cast(source_count >= 3 AS int) AS source_richness_flag FROM cons",
    "consensus_top": f"{CONSENSUS} SELECT sequence, consensus_tier, consensus_score FROM cons ORDER BY consensus_tier, CASE WHEN consensus_score = 0 THEN 999999 ELSE -consensus_score END, sequence LIMIT 100",
    "consensus_abcx": f"""{FLAGGED} SELECT sequence, consensus_tier, CASE consensus_tier WHEN 'Tier_A' THEN 1 WHEN 'Tier_B' THEN 2 WHEN 'Tier_C' THEN 3 ELSE 9 END AS consensus_rank, cast(consensus_tier IN ('Tier_A', 'Tier_B') AS int) AS consensus_keep_flag,
      round(CASE consensus_tier WHEN 'Tier_A' THEN 3000.0::double WHEN 'Tier_B' THEN 2000 WHEN 'Tier_C' THEN 1000 ELSE 0 END + source_count * 20.0::double + record_count_total * 5.0::double + CASE WHEN x > 0 THEN greatest(0.0, 100.0 - least(x, 100.0)) ELSE 0.0 END, 4) AS priority_score,
      CASE consensus_tier WHEN 'Tier_A' THEN '跨来源一致；' WHEN 'Tier_B' THEN '单源或局部多源范围内一致；' WHEN 'Tier_C' THEN '单条证据；' ELSE '存在冲突或状态未明；stability_flag=' || stability_flag || '; ' END || 'source_count=' || source_count || '; record_count=' || record_count_total
      || CASE WHEN x IS NOT NULL AND consensus_tier <> 'Tier_C' THEN '; spread_ratio=' || printf('%.4f', x) ELSE '' END AS consensus_note FROM flagged""",
    "conflict_detail": f"""{FLAGGED} SELECT sequence, source_count, record_count_total, {RATIO}, CASE WHEN stability_flag = 'conflicting' AND source_count >= 2 AND x > 10 THEN 'cross_source_large_spread' WHEN stability_flag = 'conflicting' AND x > 10 THEN 'large_within_sequence_spread'
      WHEN stability_flag = 'conflicting' THEN 'conflicting_flag_from_merged_input' WHEN x IS NULL THEN 'spread_ratio_missing' ELSE 'unknown_flag_from_merged_input' END AS conflict_reason,
      CASE WHEN x IS NULL THEN 'unknown' WHEN source_count >= 2 AND x >= 100 THEN 'very_high' WHEN x >= 100 THEN 'high' WHEN x >= 10 THEN 'medium' ELSE 'low' END AS conflict_severity FROM flagged WHERE consensus_tier = 'Tier_X'""",
    "stored_consensus": f"SELECT row_id, {CONSENSUS_COLS} FROM (SELECT *, {OK} FROM (SELECT *, CASE WHEN NOT isnan({RATIO}) THEN {RATIO} END AS x, CASE WHEN NOT isnan(ic50_uM_median) THEN ic50_uM_median END AS med FROM ace_short_2_3_merged_sequence_level_v0_3))",
    "conflict_source_assay": f"{EXACT_VALUES} SELECT sequence, v_list, n_sources, sources_list, n_assays, assays_list, cast(n_sources >= 2 AS int) AS cross_source, cast(n_assays >= 2 AS int) AS cross_assay FROM ev",
    "exact_conflicts": f"{EXACT_VALUES} SELECT sequence, dup_count, n_values, v_list, sources_list, assays_list, ids_list FROM ev",
    "benchmark_bucket": f"""{CONSENSUS} SELECT sequence, consensus_tier, consensus_score, source_count, {RATIO}, CASE consensus_tier WHEN 'Tier A' THEN 'Tier_A' WHEN 'Tier B' THEN 'Tier_B' WHEN 'Tier C' THEN 'Tier_C_single_source' WHEN 'Tier D' THEN 'Tier_D_conflicting' ELSE 'Tier_E_insufficient' END AS refined_tier,
      CASE WHEN consensus_tier IN ('Tier A', 'Tier B') THEN 'high_confidence_core' WHEN consensus_tier = 'Tier C' THEN 'single_source_candidates' ELSE 'conflict_review_pool' END AS benchmark_bucket, ascii(right(consensus_tier, 1)) - 64 AS benchmark_priority,
      CASE consensus_tier WHEN 'Tier A' THEN 'high-consensus short peptide candidate' WHEN 'Tier B' THEN 'high-consensus short peptide candidate' WHEN 'Tier C' THEN 'single-source usable IC50 candidate' WHEN 'Tier D' THEN 'multi-source conflicting short peptide; requires review' ELSE 'insufficient or unclear evidence pattern' END
      || '; spread_ratio=' || CASE WHEN x IS NULL THEN 'NA' ELSE printf('%.4f', x) END || '; source_count=' || source_count || '; score=' || consensus_score AS benchmark_note FROM cons""",
    "highconf_aggregate": f"{HIGHCONF} SELECT * FROM hc",
    "high_conflicts": f"{HIGHCONF} SELECT sequence, record_count, n_unique, um_min, um_max, um_median, fold, stability_class, source_count, assay_count, source_list, assay_list FROM hc WHERE stability_class <> 'stable' OR fold > 3",
    "stable_activity_tier": f"{HIGHCONF} SELECT activity_tier, count(*) AS n FROM hc WHERE stability_class = 'stable' GROUP BY 1",
    "label_grade": f"""{WITH_ASSAY}, g AS (SELECT CASE WHEN regexp_matches(sequence, '^[{AA}]+$') AND exact = 1 AND status = 'exact' AND um IS NOT NULL THEN 'A' WHEN status IN ('threshold', 'range') OR starts_with(status, 'mass_') THEN 'B' ELSE 'C' END AS grade, length(sequence) AS n FROM assay JOIN ahtpdb USING (ic50_raw)),
      c AS (SELECT d.grade, count(g.grade) AS n, count(*) FILTER (g.n = 2) AS n_di, count(*) FILTER (g.n = 3) AS n_tri FROM (VALUES ('A'), ('B'), ('C')) d(grade) LEFT JOIN g USING (grade) GROUP BY d.grade) SELECT grade, n, n_di, n_tri, round(100 * n / sum(n) OVER (), 2) AS pct FROM c""",
    "multiplicity_histogram": f"{RECORDS} SELECT m AS multiplicity, count(*) AS n_keys, m * count(*) AS n_rows FROM (SELECT count(*) AS m FROM records GROUP BY sequence) GROUP BY m",
    "null_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS total, count(*) - count({clean(c)}) AS missing, count({clean(c)}) AS present, round((count(*) - count({clean(c)})) / count(*), 6) AS missing_ratio FROM fermfoodb_ace_list" for c in LIST_COLUMNS),
    "duplicate_check": f"{LISTS} SELECT num, count(*) AS n FROM l WHERE num IS NOT NULL GROUP BY num HAVING count(*) > 1",
    "length_by_layer": f"""WITH t AS (SELECT length({seq('sequence')}) AS len, coalesce({clean('ic50_parse_status')} = 'exact_molar', false) AS exact, CASE WHEN isfinite(ic50_uM) THEN ic50_uM END AS um FROM fermfoodb_ace_master_clean),
      u AS (SELECT 'all' AS layer, len FROM t UNION ALL SELECT 'exact', len FROM t WHERE exact UNION ALL SELECT 'strong', len FROM t WHERE exact AND um <= 50), n AS (SELECT layer, len, count(*) AS n FROM u WHERE len IS NOT NULL GROUP BY 1, 2),
      f AS (SELECT layer, len FROM n UNION SELECT l, i FROM (VALUES ('all'), ('exact'), ('strong')) AS a(l), range(1, 21) AS b(i))
      SELECT layer, len, coalesce(n, 0) AS n, round(coalesce(coalesce(n, 0) / nullif(sum(n) OVER (PARTITION BY layer), 0), 0), 6) AS share FROM f LEFT JOIN n USING (layer, len)""",
    "group_counts": f"{HIGHCONF} " + " UNION ALL ".join(f"SELECT '{g}' AS grp, count(*) FILTER (peptide_length = 2) AS n_di, count(*) FILTER (peptide_length = 3) AS n_tri, cast(coalesce(sum(record_count), 0) AS bigint) AS n_records FROM hc WHERE {c}" for g, c in (("all", "true"), ("stable", "stability_class = 'stable'"), ("strong", "activity_tier = 'strong'"), ("stable_strong", "stability_class = 'stable' AND activity_tier = 'strong'"), ("weak", "activity_tier = 'weak'"))),
    "fold_bins": f"{HIGHCONF} SELECT bin, n, round(100 * n / sum(n) OVER (), 2) AS pct FROM (SELECT {FOLD_BINS} AS bin, count(*) AS n FROM hc GROUP BY 1)",
    "spread_buckets": f"{LEVEL} SELECT CASE WHEN {RATIO} IS NULL THEN 'missing' WHEN {RATIO} <= 2 THEN 'le_2' WHEN {RATIO} <= 5 THEN 'gt_2_le_5' WHEN {RATIO} <= 10 THEN 'gt_5_le_10' WHEN {RATIO} <= 100 THEN 'gt_10_le_100' ELSE 'gt_100' END AS bucket, count(*) AS n FROM level GROUP BY 1",
    "terminal_freq": f"{HIGHCONF}, {shares(END_GROUPS, {'term': ['N', 'C'], 'grp': ['all-di', 'all-tri', 'strong-di', 'strong-tri']})} SELECT * FROM shown",
    "position_freq": f"{HIGHCONF}, {shares(PLACES, {'place': PLACE_NAMES})} SELECT * FROM shown",
    "position_enrichment": f"{HIGHCONF}, {enrich(PLACES, 'place', PLACE_NAMES)} SELECT * FROM enriched",
    "terminal_enrichment": f"{HIGHCONF}, {enrich(ENDS, 'term', ['N', 'C'])} SELECT * FROM enriched",
    "topk_enriched": f"{HIGHCONF}, {enrich(ENDS, 'term', ['N', 'C'])} SELECT term, cast(rank AS int) AS rank, residue, log2fc FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY abs(log2fc) DESC, residue) AS rank FROM enriched) WHERE rank <= 15",
    "reverse_exists": f"{RECORDS}, s AS (SELECT DISTINCT sequence FROM records) SELECT sequence, cast(reverse(sequence) IN (SELECT sequence FROM s) AS int) AS reverse_exists_flag FROM s",
    "reverse_pairs": f"""{HIGHCONF} SELECT a.sequence AS seq_a, b.sequence AS seq_b, a.type, a.um_median AS value_a, b.um_median AS value_b, CASE WHEN a.um_median > 0 AND b.um_median > 0 THEN {sig6("greatest(a.um_median, b.um_median) / least(a.um_median, b.um_median)")} END AS fold,
      round(CASE WHEN a.um_median > 0 AND b.um_median > 0 THEN abs(log10(a.um_median) - log10(b.um_median)) END, 6) AS log_gap,
      CASE WHEN NOT (a.um_median > 0 AND b.um_median > 0) THEN 'undecided' WHEN abs(a.um_median - b.um_median) < 1e-12 THEN 'tie' WHEN a.um_median < b.um_median THEN a.sequence ELSE b.sequence END AS stronger,
      a.activity_tier AS tier_a, b.activity_tier AS tier_b, cast(a.activity_tier = 'strong' AND b.activity_tier = 'strong' AS int) AS both_strong FROM st a JOIN st b ON b.sequence = reverse(a.sequence) AND a.sequence < b.sequence""",
    "metric_summary": "SELECT 'total' AS metric, count(*) AS value FROM fermfoodb_ace_master_clean" + "".join(f" UNION ALL SELECT '{c}::' || coalesce({c}, 'NA'), count(*) FROM fermfoodb_ace_master_clean GROUP BY 1" for c in ("source_name", "ic50_relation", "source_type")),
    "merged_ids": f"{LEVEL} SELECT sequence, printf('ace_merged_%06d', row_number() OVER (ORDER BY peptide_length, sequence)) AS merged_id FROM level",
    "rare_class_filter": f"WITH t AS (SELECT DISTINCT {seq('peptide_sequence')} AS seq, {clean('activity')} AS label FROM fermfoodb_ace_detail) SELECT seq, label FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM t WHERE seq IS NOT NULL AND label IS NOT NULL) WHERE n >= 2",
    "mass_from_sequence": f"{PEPTIDES} SELECT seq, round({WATER} + list_sum(list_transform(string_split(seq, ''), lambda r: {TABLE})), 5) AS mass FROM p",
    "aac_features": f"{PEPTIDES} SELECT seq, i, round(x, 6) AS x FROM (SELECT seq, unnest(range(0, 21))::int AS i, unnest(list_concat(list_transform(string_split('{AA}', ''), lambda a: (length(seq) - length(replace(seq, a, ''))) / length(seq)), [length(seq)::double])) AS x FROM p)",
    "signal_moments": f"{PEPTIDES}, r AS (SELECT seq, unnest(string_split(seq, '')) AS r FROM p), v AS (SELECT seq, {HYDRO}::double AS x FROM r) SELECT seq, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS least, round(max(x), 6) AS greatest, round(avg(x * x), 6) AS energy FROM v GROUP BY seq",
    "html_table_extract": f"{ENTRIES} SELECT list_page_url AS url, cast(row_number() OVER (PARTITION BY list_page_url ORDER BY row_id) AS int) AS row_no, {squeezed('fmdb_id')} AS \"FMDB ID\", {squeezed('peptide_sequence')} AS \"Sequence\", {squeezed('ic50_raw')} AS \"IC50\" FROM e",
    "html_to_text": f"{ENTRIES} SELECT list_page_url AS url, {norm("'Page 1 of 3 FMDB ID Sequence IC50 ' || string_agg(fmdb_id || ' ' || peptide_sequence || ' ' || ic50_raw, ' ' ORDER BY row_id)")} AS text FROM e GROUP BY 1",
    "page_links": f"{ENTRIES} SELECT list_page_url AS url, detail_url AS href, {squeezed('fmdb_id')} AS label FROM e WHERE detail_url <> ''",
    "page_crawl": f"""WITH RECURSIVE l AS (SELECT DISTINCT {url('list_page_url')} AS url, {url('detail_url')} AS target FROM fermfoodb_ace_list WHERE list_page_url IS NOT NULL AND detail_url IS NOT NULL AND regexp_extract({url('detail_url')}, '^[^:]*://([^/]*)', 1) = 'fermfood.example'),
      seen AS (SELECT DISTINCT {url('list_page_url')} AS url, 0 AS depth FROM fermfoodb_ace_list WHERE list_page_url IS NOT NULL UNION SELECT target, depth + 1 FROM seen JOIN l USING (url) WHERE depth < 2) SELECT url, cast(min(depth) AS int) AS depth FROM seen GROUP BY url""",
    "fft_features": FUSION,
}
