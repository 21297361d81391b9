"""DuckDB SQL for the text problems that SQL can express, written from their definitions."""

from __future__ import annotations

from assaylake.functions.text import MISSING_TOKENS
from assaylake.llm.representative import THREE_LETTER

TOKENS = ", ".join(f"'{t}'" for t in MISSING_TOKENS)
CODES = "|".join(THREE_LETTER)
DECODE = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in THREE_LETTER.items()) + " END"
LETTERS, INNER = "regexp_replace(up, '[^A-Z]', '', 'g')", "regexp_replace(core, '[^A-Z]', '', 'g')"
SPELLED = f"array_to_string(list_transform(regexp_extract_all(inn, '.{{3}}'), lambda t: {DECODE}), '')"
PEPTIDES = f"""u AS (SELECT *, trim(regexp_replace(upper(sequence), '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')) AS up FROM ace_short_2_3_merged_sequence_level_v0_3),
v AS (SELECT *, regexp_replace(up, '^(?:H2N|H|AC|BZ|BOC|FMOC|PGLU)[^A-Z0-9]+|[^A-Z0-9]+(?:OH|NH2|COOH|OME|OET)$', '', 'g') AS core FROM u WHERE sequence IS NOT NULL AND lower(up) NOT IN ({TOKENS})),
w AS (SELECT *, {LETTERS} AS let, {INNER} AS inn FROM v),
p AS (SELECT *, CASE WHEN length(let) = peptide_length THEN let WHEN length(inn) = 3 * peptide_length AND regexp_matches(inn, '^(?:{CODES})+$') THEN {SPELLED} ELSE inn END AS peptide FROM w)"""

ORACLES = {
    "p3_found": f"""WITH {PEPTIDES},
ranked AS (SELECT *, CASE WHEN ic50_uM_median > 0 AND NOT isnan(ic50_uM_median) THEN row_number() OVER (PARTITION BY merge_batch, peptide, coalesce(ic50_uM_median > 0 AND NOT isnan(ic50_uM_median), false) ORDER BY source_count DESC, merged_at DESC, row_id) END AS ri,
  CASE WHEN lower(trim(ic50_status_set)) NOT IN ({TOKENS}) THEN row_number() OVER (PARTITION BY merge_batch, peptide, coalesce(lower(trim(ic50_status_set)) NOT IN ({TOKENS}), false) ORDER BY source_count DESC, merged_at DESC, row_id) END AS rs FROM p WHERE peptide <> '')
SELECT min(row_id) AS group_row_id, coalesce(max(row_id) FILTER (ri = 1), 0) AS ic50_row_id, coalesce(max(row_id) FILTER (rs = 1), 0) AS status_row_id FROM ranked GROUP BY merge_batch, peptide HAVING count(*) >= 2""",
    "p8_found": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents), e AS (SELECT item_id, regexp_extract_all(lower(coalesce(item_text, '')), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM d), eg AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM e)
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""".replace("\\\\", "\\"),
}
ORACLES["p7_decoded"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
ORACLES["p8_items"] = f"SELECT item_id, count(*) AS n_docs FROM ({ORACLES['p8_found']}) GROUP BY item_id"


def survivors(texts: list[str], amounts: list[str], counts: list[str]) -> str:
    """Truth discovery as a recursive query: trust 0.8 at first, 0.01 at least, until none moves by 0.0001."""
    shown = {c: f"CASE WHEN lower(trim({c})) NOT IN ({TOKENS}) THEN {c} END" for c in texts}
    shown |= {c: f"CASE WHEN {c} > 0 AND NOT isnan({c}) THEN cast({c} AS varchar) END" for c in amounts}
    shown |= {c: f"cast({c} AS varchar)" for c in counts}
    kinds = {c: "varchar" for c in texts} | {c: "double" for c in amounts} | {c: "int" for c in counts}
    long = " UNION ALL ".join(f"SELECT merge_batch, peptide, r, s, '{c}' AS field, {e} AS value FROM q" for c, e in shown.items())
    fields = ", ".join(f"cast(max(value) FILTER (field = '{c}') AS {k}) AS {c}" for c, k in kinds.items())
    cell = "merge_batch, peptide, field"
    return f"""WITH RECURSIVE {PEPTIDES},
q0 AS (SELECT *, row_number() OVER (ORDER BY source_count NULLS FIRST, merged_at NULLS FIRST, row_id DESC) AS r, list_filter(regexp_split_to_array(coalesce(source_name_set, ''), '\\s*\\|\\s*'), lambda x: x <> '') AS s0 FROM p WHERE peptide <> ''),
q AS (SELECT *, CASE WHEN len(s0) > 0 THEN s0 ELSE [''] END AS s FROM q0),
claims AS MATERIALIZED (SELECT {cell}, value, max(r) AS r, list_distinct(flatten(list(s))) AS side FROM ({long}) WHERE value IS NOT NULL GROUP BY ALL),
c AS MATERIALIZED (SELECT {cell}, value, unnest(side) AS source FROM claims),
d AS MATERIALIZED (SELECT c.* FROM c JOIN (SELECT {cell} FROM claims GROUP BY ALL HAVING count(*) >= 2) USING ({cell})),
t AS (SELECT 0 AS round, source, 0.8::double AS trust, 1.0::double AS moved FROM (SELECT DISTINCT source FROM c)
  UNION ALL SELECT round, source, new, max(abs(new - trust)) OVER () FROM (SELECT t.round + 1 AS round, t.source, t.trust, coalesce(greatest(l.learned, 0.01), t.trust) AS new FROM t LEFT JOIN (
    SELECT source, avg(share) AS learned FROM (SELECT {cell}, value, votes / sum(votes) OVER (PARTITION BY {cell}) AS share FROM (SELECT {cell}, value, sum(trust) AS votes FROM d JOIN t USING (source) GROUP BY ALL)) JOIN d USING ({cell}, value) GROUP BY source) l ON l.source = t.source
    WHERE t.moved >= 1e-4 AND t.round < 300)),
last AS (SELECT source, trust FROM t WHERE round = (SELECT max(round) FROM t)),
best AS (SELECT {cell}, arg_max(value, struct_pack(votes, r)) AS value FROM (SELECT {cell}, value, r, round(sum(trust), 9) AS votes FROM c JOIN last USING (source) JOIN claims USING ({cell}, value) GROUP BY ALL) GROUP BY ALL),
record AS (SELECT merge_batch, peptide, {fields} FROM best GROUP BY ALL)
SELECT min(q.row_id) AS group_row_id, q.merge_batch, q.peptide, count(*) AS n_rows, {", ".join(f"any_value(record.{c}) AS {c}" for c in kinds)}, max(q.merged_at) AS merged_at FROM q LEFT JOIN record ON record.merge_batch = q.merge_batch AND record.peptide = q.peptide GROUP BY q.merge_batch, q.peptide"""
