"""DuckDB SQL for the general data problems, written from their definitions."""

from __future__ import annotations

from assaylake.functions.text import MISSING_TOKENS

TOKENS = ", ".join(f"'{t}'" for t in MISSING_TOKENS)
FMDB = r"(?i)fmdb[\s_\-\x{A0}\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{AD}]*([0-9]+)"


def _num(c: str) -> str:
    return f"try_cast(regexp_extract({c}, '{FMDB}', 1) AS bigint)"


def _month(c: str) -> str:
    return f"strftime({c}, '%Y-%m')"


REFS = f"""refs AS (
  SELECT 'fermfoodb_ace_list' AS ref_table, row_id, {_num('fmdb_id')} AS fmdb_no, {_month('crawled_at')} AS period, 'd' AS target FROM fermfoodb_ace_list
  UNION ALL SELECT 'fermfoodb_ace_detail', row_id, {_num('fmdb_id')}, {_month('fetched_at')}, 'l' FROM fermfoodb_ace_detail
  UNION ALL SELECT DISTINCT 'fermfoodb_ace_master_clean', row_id, try_cast(unnest(regexp_extract_all(coalesce(notes, ''), '{FMDB}', 1)) AS bigint), {_month('standardized_at')}, 'l' FROM fermfoodb_ace_master_clean),
targets AS (SELECT 'l' AS target, {_num('fmdb_id')} AS fmdb_no, {_month('crawled_at')} AS arr, coalesce({_month('withdrawn_at')}, '9999-99') AS wd FROM fermfoodb_ace_list
  UNION ALL SELECT 'd', {_num('fmdb_id')}, {_month('fetched_at')}, coalesce({_month('withdrawn_at')}, '9999-99') FROM fermfoodb_ace_detail),
judged AS (SELECT r.ref_table, r.row_id, r.fmdb_no, r.period, count(t.fmdb_no) AS n, count(*) FILTER (t.arr <= r.period) AS by_then, max(t.wd) FILTER (t.arr <= r.period) AS last
  FROM refs r LEFT JOIN targets t ON t.target = r.target AND t.fmdb_no = r.fmdb_no WHERE r.fmdb_no IS NOT NULL AND r.period IS NOT NULL GROUP BY ALL),
orphans AS (SELECT *, CASE WHEN n = 0 THEN 'missing' WHEN by_then = 0 THEN 'late' WHEN last <= period THEN 'deleted' END AS orphan_kind FROM judged)"""


def _text(c: str) -> str:
    return f"(CASE WHEN lower(trim({c})) NOT IN ({TOKENS}) THEN lower(trim({c})) END)"


FILLS = f"""r AS (SELECT row_id, rescue_batch AS b, CASE WHEN {_text('sequence')} IS NOT NULL THEN upper(regexp_replace(sequence, '[\\s\\-]+', '', 'g')) END AS s,
    CASE WHEN mass_da > 0 AND NOT isnan(mass_da) THEN cast(floor(mass_da * 1000 + 0.5) AS bigint)::varchar END AS mass_da, {_text('mass_da_source')} AS mass_da_source, {_text('rescue_action')} AS rescue_action FROM fermfoodb_ace_master_rescued),
long AS (SELECT * FROM r UNPIVOT INCLUDE NULLS (v FOR field_name IN (mass_da, mass_da_source, rescue_action))),
grp AS (SELECT b, s, field_name, min(v) AS v FROM long WHERE s IS NOT NULL AND v IS NOT NULL GROUP BY ALL HAVING count(DISTINCT v) = 1)"""

ORACLES = {
    "p4_found": f"WITH {REFS} SELECT ref_table, row_id, fmdb_no, orphan_kind, period FROM orphans WHERE orphan_kind IS NOT NULL",
    "p4_report": f"WITH {REFS} SELECT ref_table, period, orphan_kind, count(*) AS n_refs, count(DISTINCT fmdb_no) AS n_keys FROM orphans WHERE orphan_kind IS NOT NULL GROUP BY ALL",
    "p5_found": f"WITH {FILLS} SELECT l.row_id, l.field_name, g.v AS fill_text FROM long l JOIN grp g ON g.b = l.b AND g.s = l.s AND g.field_name = l.field_name WHERE l.v IS NULL",
}
