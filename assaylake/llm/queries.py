"""Queries of the text problems: representatives, plain text, token ids, leaked passages, cut texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.text import MISSING_TOKENS, clean_text
from assaylake.llm import leakage, plain_text, representative, tokens, truncation
from assaylake.llm.sql import ORACLES, survivors
from assaylake.session import cut_lineage, table

GROUP = ["merge_batch", "peptide"]
MERGED = "ace_short_2_3_merged_sequence_level_v0_3"
#: Fields chosen one by one for the surviving record: texts, numbers that must be above 0, whole numbers.
SURVIVING_TEXTS = [
    "sequence", "source_name_set", "merged_record_id_list", "source_record_id_list", "species_set", "protein_id_set", "doi_set", "ic50_relation_set",
    "ic50_status_set", "stability_flag", "stability_note", "database_reference_raw_set",
]
SURVIVING_AMOUNTS = ["ic50_uM_min", "ic50_uM_max", "ic50_uM_mean", "ic50_uM_median", "ic50_spread_ratio_max_min"]
SURVIVING_COUNTS = [
    "peptide_length", "source_count", "record_count_total", "record_count_ahtpdb", "record_count_biopep", "record_count_mbpdb", "record_count_fermfooddb",
    "cross_source_overlap_flag", "bibliographic_year_min", "bibliographic_year_max",
]
SURVIVING = [*SURVIVING_TEXTS, *SURVIVING_AMOUNTS, *SURVIVING_COUNTS]


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representative.grouped(table(spark, sf_dir, MERGED).select("row_id", *SURVIVING, "merge_batch", "merged_at"), "merge_batch", "sequence", "peptide_length")


def _fields(names: list[str]) -> dict:
    fields = {}
    for n in names:
        v = F.col(n)
        if n in SURVIVING_TEXTS:
            fields[n] = F.when(~F.lower(F.trim(v)).isin(MISSING_TOKENS), v)
        else:
            fields[n] = F.when(~F.isnan(v) & (v > 0), v) if n in SURVIVING_AMOUNTS else v
    return fields


def _precedence():
    return F.struct("source_count", "merged_at", (-F.col("row_id")).alias("neg_row"))


def _claims(rows: DataFrame, names: list[str]) -> DataFrame:
    sources = F.filter(F.split(F.coalesce("source_name_set", F.lit("")), r"\s*\|\s*"), lambda x: x != "")
    return representative.claims(rows, GROUP, _fields(names), sources, _precedence())


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_id").alias("group_row_id")).where("n_rows >= 2")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose values the stated precedence puts first.

    Nothing makes up for its lead, so reliabilities of sources are not learned; p3_survivors is what they decide.
    """
    rows = _merged(spark, sf_dir)
    groups = _groups(rows)
    c = _claims(rows, ["ic50_uM_median", "ic50_status_set"])
    best, _ = representative.truth_discovery(c, GROUP, lead=representative.outweighing(c))

    def row_of(field: str):
        return F.coalesce(F.max(F.when(F.col("field") == field, -F.col("best.neg_row"))), F.lit(0))

    chosen = best.groupBy(*GROUP).agg(row_of("ic50_uM_median").alias("ic50_row_id"), row_of("ic50_status_set").alias("status_row_id"))
    same = F.col("g.merge_batch").eqNullSafe(F.col("c.merge_batch")) & (F.col("g.peptide") == F.col("c.peptide"))
    return groups.alias("g").join(chosen.alias("c"), same, "left").select("group_row_id", F.coalesce("ic50_row_id", F.lit(0)).alias("ic50_row_id"), F.coalesce("status_row_id", F.lit(0)).alias("status_row_id"))


def p3_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per peptide and batch, each field by the support that truth discovery alone finds for its values."""
    rows = _merged(spark, sf_dir)
    best, _ = representative.truth_discovery(cut_lineage(_claims(rows, SURVIVING)), GROUP)
    kinds = dict(rows.dtypes)
    record = best.groupBy(*GROUP).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).cast(kinds[f]).alias(f) for f in SURVIVING])
    sizes = rows.groupBy(*GROUP).agg(F.min("row_id").alias("group_row_id"), F.count(F.lit(1)).alias("n_rows"), F.max("merged_at").alias("merged_at"))
    return sizes.join(record, GROUP, "left").select("group_row_id", *GROUP, "n_rows", *SURVIVING, "merged_at")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_text.differing(table(spark, sf_dir, "fermfoodb_ace_master_clean"), "row_id", ["ic50_raw", "sequence"])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), "text", "doc_id")


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text back from its ids; null and empty texts are empty."""
    return tokens.decode(p7_ids(spark, sf_dir), "ids", "doc_id")


def p7_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ids each text has and how many bytes they cover, from the ids' offsets."""
    t = tokens.encode(table(spark, sf_dir, "documents"), "text", "doc_id", offsets=True)
    return t.select("doc_id", F.size("ids").alias("n_ids"), F.coalesce(F.try_element_at("offsets", F.lit(-1)), F.lit(0)).alias("last_id_at"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "item_text")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents leak each item."""
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "documents"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", clean_text(F.col("source")).alias("source"))
    return truncation.rates(docs)


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_survivors, p6_found, p7_ids, p7_decoded, p7_offsets, p8_found, p8_items, p9_found, p9_rates)}


def oracle_sql() -> dict[str, str]:
    return ORACLES | {"p3_survivors": survivors(SURVIVING_TEXTS, SURVIVING_AMOUNTS, SURVIVING_COUNTS)}
