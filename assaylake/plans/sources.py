"""Four standardised sources in one merged schema: eligibility, mapping, union, order and ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.numeric import flag
from assaylake.functions.text import clean_sequence, clean_text, set_join
from assaylake.operators.relational import numbered

# The merged schema, the statuses that may enter it, and what the mappers write.
MERGED_COLUMNS = [
    "merged_record_id", "task", "source_name", "source_level", "source_record_id", "sequence", "peptide_length", "sequence_valid_flag", "noncanonical_flag", "ic50_raw",
    "ic50_relation", "ic50_value", "ic50_unit", "ic50_uM", "ic50_status", "assay_raw", "source_context_raw", "species_raw", "protein_id_raw", "protein_description_raw",
    "bibliographic_raw", "doi_raw", "database_reference_raw", "is_dipeptide", "is_tripeptide", "merge_note",
]
RESOLVED = ["exact_molar", "molar_threshold"]
SOURCE_COUNTS = {"AHTPDB": "ahtpdb", "BIOPEP-UWM": "biopep", "MBPDB": "mbpdb", "FermFooDb": "fermfooddb"}


def _finite(c: Column) -> Column:
    v = c.cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def _text(c: str) -> Column:
    """Cleaned, and empty instead of null."""
    return F.coalesce(clean_text(F.col(c)), F.lit(""))


def _joined(*columns: str) -> Column:
    return set_join(F.array(*[clean_text(F.col(c).cast("string")) for c in columns]))


def _mapped(df: DataFrame, name: str, level: str, note: str, given: dict[str, Column]) -> DataFrame:
    base = {
        "task": F.lit("ace"), "source_name": F.lit(name), "source_level": F.lit(level), "source_record_id": clean_text(F.col("source_record_id")),
        "sequence_valid_flag": F.lit(1), "noncanonical_flag": F.lit(0), "ic50_raw": clean_text(F.col("ic50_raw")), "ic50_relation": clean_text(F.col("ic50_relation")),
        "ic50_value": _finite(F.col("ic50_value")), "ic50_uM": _finite(F.col("ic50_uM")), "merge_note": F.lit(note),
        **{c: F.lit("") for c in ("species_raw", "protein_id_raw", "protein_description_raw", "bibliographic_raw", "doi_raw", "database_reference_raw")},
    }
    return df.select(*[(base | given)[c].alias(c) for c in MERGED_COLUMNS if c != "merged_record_id"], F.col("ord").cast("bigint").alias("ord"))


def _eligible(df: DataFrame) -> DataFrame:
    """A sequence, a length, a value and a resolved status; letters are not looked at."""
    return df.where(clean_sequence(F.col("sequence")).isNotNull() & F.col("peptide_length").isNotNull() & _finite(F.col("ic50_uM")).isNotNull() & clean_text(F.col("ic50_parse_status")).isin(RESOLVED))


def _common(length: Column) -> dict[str, Column]:
    return {
        "sequence": clean_sequence(F.col("sequence")), "peptide_length": length, "ic50_unit": clean_text(F.col("ic50_unit")), "ic50_status": clean_text(F.col("ic50_parse_status")),
        "is_dipeptide": F.coalesce((length == 2).cast("int"), F.lit(0)), "is_tripeptide": F.coalesce((length == 3).cast("int"), F.lit(0)),
    }


def map_ahtpdb(df: DataFrame) -> DataFrame:
    """Valid canonical sequences with an exact value or a threshold; the only source that asks for canonical letters."""
    kind = clean_text(F.col("ic50_type"))
    kept = df.where((flag(F.col("sequence_valid")) == 1) & (flag(F.col("sequence_has_noncanonical_char")) == 0) & _finite(F.col("ic50_uM")).isNotNull() & kind.isin("exact", "threshold"))
    return _mapped(kept, "AHTPDB", "ahtpdb_standardized", "mapped_from_ahtpdb_master_clean_um_expanded", {
        "source_record_id": clean_text(F.col("id")), "sequence": clean_sequence(F.col("sequence_clean")), "peptide_length": F.col("len_clean").cast("int"),
        "ic50_unit": clean_text(F.col("ic50_unit_raw")), "ic50_status": F.when(kind == "exact", "exact_molar").otherwise("molar_threshold"),
        "assay_raw": _joined("method_raw", "assay_raw", "mice_raw"), "source_context_raw": _joined("source_raw", "table_from"),
        "is_dipeptide": flag(F.col("is_dipeptide")), "is_tripeptide": flag(F.col("is_tripeptide")),
    })


def map_biopep(df: DataFrame) -> DataFrame:
    return _mapped(_eligible(df), "BIOPEP-UWM", "biopep_core_workset", "mapped_from_biopep_ic50_core_record_level", _common(F.col("peptide_length").cast("int")) | {
        "assay_raw": _joined("activity_measure_label_raw", "measure_type_raw", "function_text_raw"), "source_context_raw": _joined("source_name", "source_type", "target", "evidence_type"),
        "bibliographic_raw": _text("bibliographic_raw"), "database_reference_raw": _text("database_reference_raw"),
    })


def map_mbpdb(df: DataFrame) -> DataFrame:
    return _mapped(_eligible(df), "MBPDB", "mbpdb_core_workset", "mapped_from_mbpdb_ace_core_record_level", _common(F.col("peptide_length").cast("int")) | {
        "assay_raw": _joined("function_raw", "inhibition_type_raw", "additional_details_raw"), "source_context_raw": _joined("source_name", "source_type", "target", "intervals_raw"),
        "species_raw": _text("species_raw"), "protein_id_raw": _text("protein_id_raw"), "protein_description_raw": _text("protein_description_raw"),
        "bibliographic_raw": _joined("title_raw", "authors_raw", "abstract_raw"), "doi_raw": _text("doi_raw"),
    })


def map_fermfood(df: DataFrame) -> DataFrame:
    return _mapped(_eligible(df), "FermFooDb", "fermfooddb_core_strict_workset", "mapped_from_fermfooddb_ace_core_strict_record_level", _common(F.col("peptide_length").cast("int")) | {
        "assay_raw": _joined("assay_raw", "method_of_analysis_raw"), "source_context_raw": _joined("food_matrix_raw", "culture_raw", "hydrolysis_raw", "experiment_raw", "model_raw"),
        "protein_description_raw": _text("protein_raw"), "bibliographic_raw": _joined("title_raw", "pubmed_id_raw"), "database_reference_raw": _text("detail_url"),
    })


def union(*mapped: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, mapped)


def merged_order() -> list[Column]:
    """Length (missing last), sequence, source, id; equal ones by source row."""
    return [F.coalesce("peptide_length", F.lit(10**9)), *[F.coalesce(c, F.lit("")) for c in ("sequence", "source_name", "source_record_id")], F.col("ord")]


def with_merged_ids(records: DataFrame) -> DataFrame:
    """The merged table: its columns in order, ids by :func:`merged_order`."""
    n = numbered(records, merged_order(), "_n")
    return n.withColumn("merged_record_id", F.format_string("ace_merged_%06d", "_n")).select(*MERGED_COLUMNS)
