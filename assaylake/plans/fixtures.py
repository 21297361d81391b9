"""Assay-shaped rows derived from the order tables, by expressions that every SQL engine reads the same way.

``{div}`` stands for the integer division of the engine. Text is only built from integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assaylake.session import table

LETTERS = "'ACDEFGHIKLMNPQRSTVWY'"
#: A short sequence; every 29th part has a letter that is no residue.
SEQUENCE = f"""(substr({LETTERS}, cast((l_partkey + l_orderkey) % 20 AS int) + 1, 1)
         || substr({LETTERS}, cast(((l_partkey * 3 + l_orderkey) {{div}} 20) % 20 AS int) + 1, 1)
         || CASE WHEN l_partkey % 4 <> 0 THEN substr({LETTERS}, cast((l_partkey * 7 + l_orderkey * 13) % 20 AS int) + 1, 1) ELSE '' END
         || CASE WHEN l_partkey % 29 = 0 THEN 'J' ELSE '' END)"""
Q = "cast(cast(l_quantity AS int) AS string)"
#: Potency texts: the usual ones by line, and by order those that reach the remaining branches of the grammars.
POTENCY = f"""CASE l_orderkey % 31
         WHEN 1 THEN {Q} || '.6 μM/L' WHEN 2 THEN {Q} || ' ' || {Q} WHEN 3 THEN 'about ' || {Q} WHEN 4 THEN 'high' WHEN 5 THEN {Q} || '.00 uM [IC50]' WHEN 6 THEN {Q} || ' [IC50]'
         WHEN 7 THEN '1) ' || {Q} || '.0, 2) 205.0' WHEN 8 THEN '<' || {Q} || ' nM' WHEN 9 THEN '≥ ' || {Q} || ' ug/ml' WHEN 10 THEN {Q} || '±0.5 umol/l' WHEN 11 THEN {Q} || ' um' WHEN 12 THEN {Q} || '~90 nM'
       ELSE CASE l_linenumber
         WHEN 1 THEN CASE WHEN cast(l_quantity AS int) % 13 = 0 THEN '0 uM' ELSE {Q} || '.5 uM' END
         WHEN 2 THEN '0.0' || cast(cast(l_quantity AS int) + 10 AS string) || ' mM'
         WHEN 3 THEN '> ' || {Q} || ' uM'
         WHEN 4 THEN '1-' || {Q} || ' uM'
         WHEN 5 THEN {Q} || ' mg/mL'
         WHEN 6 THEN {Q} || '%'
         ELSE 'ND' END END"""
ASSAY = f"""
SELECT l_orderkey, l_linenumber, l_partkey, 'R' || l_orderkey || '_' || l_linenumber AS record_id,
       CASE l_suppkey % 4 WHEN 0 THEN 'AHTPDB' WHEN 1 THEN 'BIOPEP' WHEN 2 THEN 'MBPDB' ELSE 'FermFooDb' END AS source_name,
       {SEQUENCE} AS sequence, {POTENCY} AS ic50_raw, l_returnflag AS assay, 'method ' || (l_orderkey % 3) AS method, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE 'model ' || (l_orderkey % 2) END AS model,
       l_linestatus AS species, cast(year(l_shipdate) AS int) AS year
FROM lineitem
"""


def assay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record grain: one row per line item."""
    lineitem = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    return spark.sql(ASSAY.replace("{div}", "div").replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem)
