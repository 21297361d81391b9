"""Core worksets of the three crawled sources: reasons, keeping, routing of excluded rows, and their sequence levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions import rules
from assaylake.functions.numeric import rounded, spread
from assaylake.functions.plain import once
from assaylake.functions.text import agg_set_join, clean_sequence, clean_text, has_note, is_canonical, year_earliest, year_from_digits, year_latest

# Statuses of the modes, and the note of a sequence with other letters.
STATUSES = {"strict": ["exact_molar", "molar_threshold"], "expanded": ["exact_molar", "molar_threshold", "rescued_numeric_no_unit"]}
ODD_LETTERS = "non_canonical_or_contains_unknown_residue"
EC50_FIELDS = ["measure_type_raw", "activity_measure_label_raw", "ic50_raw", "activity_name_raw", "activity_label_raw"]


def value_of(c: str = "ic50_uM") -> Column:
    """A finite number or null."""
    v = F.col(c).cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def _status() -> Column:
    return clean_text(F.col("ic50_parse_status"))


def _resolved() -> Column:
    return F.coalesce(_status().isin(STATUSES["strict"]), F.lit(False)) & value_of().isNotNull()


def biopep_tests(df: DataFrame) -> dict[str, Column]:
    seq = F.coalesce(clean_text(F.col("sequence")), F.lit(""))
    ec50 = [F.lower(F.coalesce(clean_text(F.col(c)), F.lit(""))).contains("ec50") for c in EC50_FIELDS if c in df.columns]
    return {
        "unresolved_ic50": ~_resolved(), "ec50_record": F.array_contains(F.array(*ec50), True),
        "noncanonical_or_modified_residue": seq.contains("{") | seq.contains("}") | has_note(F.col("notes"), ODD_LETTERS),
        "length_conflict": F.coalesce(clean_text(F.col("length_consistency_flag")) == "conflict", F.lit(False)),
    }


def mbpdb_tests(df: DataFrame) -> dict[str, Column]:
    return {"missing_or_unresolved_ic50": ~_resolved(), "noncanonical_or_missing_sequence": clean_text(F.col("sequence")).isNull() | has_note(F.col("notes"), ODD_LETTERS)}


def fermfood_tests(df: DataFrame) -> dict[str, Column]:
    seq = clean_sequence(F.col("sequence"))
    return {
        "sequence_missing": seq.isNull(), "noncanonical_sequence": seq.isNotNull() & ~is_canonical(seq), "peptide_length_missing": F.col("peptide_length").isNull(),
        "ic50_status_not_usable": ~F.coalesce(_status().isin(STATUSES["expanded"]), F.lit(False)), "ic50_uM_missing": value_of().isNull(),
    }


TESTS = {"biopep": biopep_tests, "mbpdb": mbpdb_tests, "fermfood": fermfood_tests}


def annotated(df: DataFrame, source: str, mode: str = "strict") -> DataFrame:
    """All rows with ``workset_tier``, ``workset_keep_flag`` and ``workset_exclusion_reasons``.

    The first two sources keep rows without a reason. FermFooDb keeps by mode, whatever the length: a row without a
    length is kept and has a reason too.
    """
    tests = TESTS[source](df)
    reasons = F.concat_ws("; ", *[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()])
    if source == "fermfood":
        seq = clean_sequence(F.col("sequence"))
        keep = F.coalesce(is_canonical(seq), F.lit(False)) & value_of().isNotNull() & F.coalesce(_status().isin(STATUSES[mode]), F.lit(False))
    else:
        keep = reasons == ""
    rows = df.withColumn("_a", once(F.struct(reasons.alias("r"), keep.cast("int").alias("k"))))
    tier = F.when(F.col("_a.k") == 1, mode).otherwise("excluded")
    return rows.withColumns({"workset_tier": tier, "workset_keep_flag": F.col("_a.k"), "workset_exclusion_reasons": F.col("_a.r")}).drop("_a")


def routed(rows: DataFrame, routes: dict[str, list[str]]) -> DataFrame:
    """Annotated rows with the ``route`` of every excluded output they belong to; one row may take several."""
    has = F.split("workset_exclusion_reasons", "; ")
    taken = F.array_compact(F.array(*[F.when(F.arrays_overlap(has, F.array(*map(F.lit, reasons))), F.lit(name)) for name, reasons in routes.items()]))
    return rows.withColumn("route", F.explode(taken))


# Excluded outputs of each source, by reason.
ROUTES = {
    "biopep": {"ec50": ["ec50_record"], "noncanonical": ["noncanonical_or_modified_residue"], "length_conflict": ["length_conflict"]},
    "mbpdb": {"missing_ic50": ["missing_or_unresolved_ic50"], "noncanonical": ["noncanonical_or_missing_sequence"]},
}
# Set columns of each source's sequence level, by the column they join.
SET_COLUMNS = {
    "biopep": {
        "record_id_list": "record_id", "source_record_id_list": "source_record_id", "source_name_set": "source_name", "ic50_parse_status_set": "ic50_parse_status",
        "ic50_relation_set": "ic50_relation", "detail_report_url_list": "detail_report_url", "notes_set": "notes",
    },
    "mbpdb": {
        "record_id_list": "record_id", "source_record_id_list": "source_record_id", "species_set": "species_raw", "protein_id_set": "protein_id_raw",
        "protein_description_set": "protein_description_raw", "doi_set": "doi_raw", "ic50_relation_set": "ic50_relation", "ic50_parse_status_set": "ic50_parse_status",
        "title_set": "title_raw", "notes_set": "notes",
    },
    "fermfood": {
        "source_record_id_list": "source_record_id", "record_id_list": "record_id", "activity_label_set": "activity_label_raw", "food_matrix_set": "food_matrix_raw",
        "protein_set": "protein_raw", "culture_set": "culture_raw", "hydrolysis_set": "hydrolysis_raw", "experiment_set": "experiment_raw", "model_set": "model_raw",
        "assay_set": "assay_raw", "method_of_analysis_set": "method_of_analysis_raw", "pubmed_id_set": "pubmed_id_raw", "title_set": "title_raw",
        "ic50_status_set": "ic50_parse_status", "ic50_relation_set": "ic50_relation",
    },
}


def _years(source: str) -> list[Column]:
    """Years of a row: the digits of its year field, the earliest of title or DOI, or the latest of title and of id."""
    if source == "biopep":
        return [year_from_digits(F.col("bibliographic_year_raw"))]
    if source == "mbpdb":
        return [year_earliest(F.col("title_raw"), F.col("doi_raw"))]
    return [year_latest(F.col("title_raw")), year_latest(F.col("pubmed_id_raw"))]


def statistics() -> list[Column]:
    um = value_of()
    return [F.min(um).alias("ic50_uM_min"), F.max(um).alias("ic50_uM_max"), F.round(F.avg(um), 6).alias("ic50_uM_mean"), F.round(F.median(um), 6).alias("ic50_uM_median")]


def sequence_level(kept: DataFrame, source: str, order: str = "row_id") -> DataFrame:
    """One row per sequence of a source's kept rows. Mean and median have six digits, since sums differ by engine."""
    seq = clean_sequence(F.col("sequence")) if source == "fermfood" else clean_text(F.col("sequence"))
    years = _years(source)
    rows = kept.withColumns({"_seq": seq, "_low": F.least(*years) if len(years) > 1 else years[0], "_high": F.greatest(*years) if len(years) > 1 else years[0]}).where("_seq is not null")
    g = rows.groupBy(F.col("_seq").alias("sequence")).agg(
        F.min_by("peptide_length", order).alias("peptide_length"), F.count(F.lit(1)).alias("record_count"), *[agg_set_join(F.col(c)).alias(n) for n, c in SET_COLUMNS[source].items()],
        *statistics(), F.min("_low").alias("bibliographic_year_min"), F.max("_high").alias("bibliographic_year_max"),
    )
    g = g.withColumn("ic50_spread_ratio_max_min", F.round(spread(F.col("ic50_uM_min"), F.col("ic50_uM_max")), 6))
    if source != "fermfood":
        return g
    ratio = F.col("ic50_spread_ratio_max_min")
    flag = rules.stability_flag(F.lit(1), F.col("record_count"), ratio)
    note = F.when(flag == "singleton", "only_one_record_in_fermfoodb").when(flag == "unknown", "spread_ratio_unavailable").otherwise(F.format_string("spread_ratio=%.4f", rounded(ratio, 4)))
    return g.withColumns({"stability_flag": flag, "stability_note": note})


def merged_level(merged: DataFrame) -> DataFrame:
    """One row per sequence of the merged table: counts by source, nine sets, statistics, years, flag and note."""
    from assaylake.plans.sources import SOURCE_COUNTS

    def joined(c: str) -> Column:
        """The mappers have cleaned the values; empty ones are none."""
        return F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), " | ")

    sets = {
        "source_name_set": "source_name", "merged_record_id_list": "merged_record_id", "source_record_id_list": "source_record_id", "species_set": "species_raw", "protein_id_set": "protein_id_raw",
        "doi_set": "doi_raw", "ic50_relation_set": "ic50_relation", "ic50_status_set": "ic50_status", "database_reference_raw_set": "database_reference_raw",
    }
    years = [year_latest(F.col(c)) for c in ("bibliographic_raw", "doi_raw", "source_context_raw")]
    rows = merged.where("sequence is not null").withColumn("_years", once(F.array(*years)))
    g = rows.groupBy("sequence").agg(
        F.min_by("peptide_length", "merged_record_id").alias("peptide_length"), F.countDistinct("source_name").alias("source_count"), F.count(F.lit(1)).alias("record_count_total"),
        *[F.count_if(F.col("source_name") == s).alias(f"record_count_{n}") for s, n in SOURCE_COUNTS.items()], *[joined(c).alias(n) for n, c in sets.items()],
        *statistics(), F.min(F.array_min("_years")).alias("bibliographic_year_min"), F.max(F.array_max("_years")).alias("bibliographic_year_max"),
    )
    ratio, n = F.round(spread(F.col("ic50_uM_min"), F.col("ic50_uM_max")), 6), F.col("source_count")
    g = g.withColumn("ic50_spread_ratio_max_min", ratio).withColumn("cross_source_overlap_flag", (n >= 2).cast("int"))
    g = g.withColumn("stability_flag", rules.stability_flag(n, F.col("record_count_total"), F.col("ic50_spread_ratio_max_min")))
    return g.withColumn("stability_note", rules.stability_note(F.col("stability_flag"), n, F.col("ic50_spread_ratio_max_min")))
