"""Standardised masters of the sources that the tables do not hold, derived from the order tables.

The SQL is read the same way by every engine; ``{div}`` stands for integer division. FermFooDb has its own table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaylake.plans.fixtures import SEQUENCE
from assaylake.session import table

AHTPDB = f"""
SELECT 'A' || l_orderkey || '_' || l_linenumber AS id, CASE l_linenumber % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'long' ELSE 'ic50' END AS table_from, {SEQUENCE} AS sequence_clean,
  CASE WHEN l_partkey % 31 = 0 THEN 0 ELSE 1 END AS sequence_valid, CASE WHEN l_partkey % 29 = 0 THEN 1 ELSE 0 END AS sequence_has_noncanonical_char, length({SEQUENCE}) AS len_clean,
  CASE WHEN l_orderkey % 19 = 0 THEN 0 ELSE 1 END AS len_match, cast(l_quantity AS int) || ' uM' AS ic50_raw,
  CASE l_linenumber WHEN 1 THEN 'exact' WHEN 2 THEN 'exact' WHEN 3 THEN 'threshold' WHEN 4 THEN 'range' WHEN 5 THEN 'mass_unit' ELSE 'exact' END AS ic50_type,
  CASE l_linenumber WHEN 3 THEN '>' WHEN 4 THEN NULL ELSE '=' END AS ic50_relation, l_quantity AS ic50_value, CASE l_linenumber WHEN 5 THEN CASE WHEN l_partkey % 2 = 0 THEN 'mg/mL' ELSE 'ug / ml' END ELSE 'uM' END AS ic50_unit_raw,
  CASE WHEN l_linenumber IN (4, 5) OR l_orderkey % 23 = 0 THEN NULL WHEN l_orderkey % 17 = 0 THEN 0.0 ELSE l_quantity * (1 + l_orderkey % 3) / 4 END AS ic50_uM,
  CASE WHEN l_linenumber IN (1, 2, 6, 7) THEN 1 ELSE 0 END AS ic50_exact_flag, CASE WHEN l_partkey % 7 <> 0 THEN cast(l_partkey % 900 AS double) END AS molwt_value,
  'src_' || l_returnflag AS source_raw, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE 'SHR' END AS mice_raw, CASE l_suppkey % 3 WHEN 0 THEN 'n/a' ELSE 'HPLC' END AS method_raw, 'assay ' || l_linestatus || l_linenumber AS assay_raw,
  CASE WHEN length({SEQUENCE}) = 2 THEN 1 ELSE 0 END AS is_dipeptide, CASE WHEN length({SEQUENCE}) = 3 THEN 1 ELSE 0 END AS is_tripeptide, l_orderkey * 10 + l_linenumber AS ord
FROM lineitem WHERE l_suppkey % 4 = 0
"""

#: What the two crawled masters share; ``<name>``, ``<part>`` and ``<rest>`` differ.
CRAWLED = f"""
SELECT '<name>' || l_orderkey || '_' || l_linenumber AS record_id, '<name>S' || l_orderkey || '_' || l_linenumber AS source_record_id, CASE WHEN l_partkey % 41 = 0 THEN NULL WHEN l_partkey % 43 = 0 THEN '{{P}}' || {SEQUENCE} ELSE {SEQUENCE} END AS sequence,
  CASE WHEN l_orderkey % 37 = 0 THEN NULL ELSE length({SEQUENCE}) END AS peptide_length, 'ACE inhibitor' AS activity_label_raw, cast(l_quantity AS int) || ' uM' AS ic50_raw, l_quantity AS ic50_value, 'uM' AS ic50_unit,
  CASE l_linenumber WHEN 3 THEN '<' ELSE '=' END AS ic50_relation, CASE WHEN l_orderkey % 23 = 0 THEN NULL WHEN l_orderkey % 17 = 0 THEN 0.0 ELSE l_quantity * (1 + l_orderkey % 5) / 4 END AS ic50_uM,
  CASE l_linenumber WHEN 3 THEN 'molar_threshold' WHEN 4 THEN 'range' WHEN 5 THEN 'n/a' ELSE 'exact_molar' END AS ic50_parse_status,
  CASE WHEN l_orderkey % 13 = 0 THEN 'checked; non_canonical_or_contains_unknown_residue' WHEN l_orderkey % 7 = 0 THEN NULL ELSE 'checked' END AS notes, 'db' AS source_type, 'ACE' AS target, <rest>,
  l_orderkey * 10 + l_linenumber AS ord
FROM lineitem WHERE l_suppkey % 4 = <part>
"""


def _crawled(name: str, part: int, rest: str) -> str:
    return CRAWLED.replace("<name>", name).replace("<part>", str(part)).replace("<rest>", rest)


BIOPEP = _crawled("B", 1, """'BIOPEP-UWM' AS source_name, 'experimental' AS evidence_type, CASE l_linenumber WHEN 6 THEN 'ec50' ELSE 'IC50' END AS measure_type_raw, 'label ' || l_returnflag AS activity_measure_label_raw, 'inhibits ACE' AS function_text_raw,
  'ACE inhibitor' AS activity_name_raw, CASE l_orderkey % 11 WHEN 0 THEN 'conflict' WHEN 1 THEN 'sequence_only' ELSE 'consistent' END AS length_consistency_flag, 'Authors X Title Y ' || (1990 + l_partkey % 30) AS bibliographic_raw,
  CASE WHEN l_partkey % 6 = 0 THEN 'n.d.' ELSE 'year ' || (1990 + l_partkey % 30) END AS bibliographic_year_raw, 'ref ' || (l_partkey % 9) AS database_reference_raw, 'https://b.example/' || (l_partkey % 12) AS detail_report_url""")
MBPDB = _crawled("M", 2, """'MBPDB' AS source_name, 'P' || (l_partkey % 50) AS protein_id_raw, 'casein ' || l_linestatus AS protein_description_raw, CASE WHEN l_linenumber = 2 THEN NULL ELSE 'Bos ' || l_returnflag END AS species_raw, '' || (l_partkey % 30) || '-' || (l_partkey % 30 + 2) AS intervals_raw,
  'ACE-inhibitory' AS function_raw, 'competitive' AS inhibition_type_raw, cast(NULL AS string) AS additional_details_raw, 'Study of ' || (1985 + l_partkey % 35) || ' and ' || (2000 + l_partkey % 9) AS title_raw, 'A. Nother' AS authors_raw, cast(NULL AS string) AS abstract_raw, CASE WHEN l_partkey % 3 = 0 THEN '10.1/x.2007.' || (l_partkey % 8) ELSE NULL END AS doi_raw""")
FERMFOOD = "SELECT *, row_id AS ord FROM fermfoodb_ace_master_clean"
BASES = {"ahtpdb": (AHTPDB, "lineitem"), "biopep": (BIOPEP, "lineitem"), "mbpdb": (MBPDB, "lineitem"), "fermfood": (FERMFOOD, "fermfoodb_ace_master_clean")}


def master(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    sql, base = BASES[source]
    sql = sql.replace("{div}", "div").replace("{P}", "{{P}}").replace(f"FROM {base}", "FROM {base}")
    return spark.sql(sql, base=table(spark, sf_dir, base))


def master_sql(source: str) -> str:
    return BASES[source][0].replace("{div}", "//")
