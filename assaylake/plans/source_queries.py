"""Queries of the sources: mapping and union, merged and per-source sequence levels, worksets, backfill, page texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.functions import ic50, rules
from assaylake.functions import text as tx
from assaylake.functions.numeric import g_text, to_float
from assaylake.functions.plain import once
from assaylake.operators import relational as rel
from assaylake.plans import pipelines as pl
from assaylake.plans import sources as src
from assaylake.plans import worksets
from assaylake.plans.fixtures import assay
from assaylake.plans.masters import master
from assaylake.plans.source_oracles import ORACLES, PAGES
from assaylake.session import table

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


MAPPERS = {"ahtpdb": src.map_ahtpdb, "biopep": src.map_biopep, "mbpdb": src.map_mbpdb, "fermfood": src.map_fermfood}


def _union(spark, d):
    return src.union(*[f(master(spark, d, s)) for s, f in MAPPERS.items()])


@query
def source_mapping(spark, d):
    """All four sources in the merged schema."""
    return _union(spark, d).withColumns({c: F.round(c, 6) for c in ("ic50_value", "ic50_uM")})


@query
def merged_master(spark, d):
    """Ids of the merged table by length, sequence, source and record id."""
    return src.with_merged_ids(_union(spark, d)).select("merged_record_id", "source_name", "source_record_id", "sequence", "peptide_length")


@query
def merged_sequence_level(spark, d):
    """One row per short sequence of the merged table, all sets included."""
    return worksets.merged_level(src.with_merged_ids(_union(spark, d)).where(F.col("peptide_length").isin(2, 3)))


@query
def merge_summary(spark, d):
    """Rows of each source before and after, and of the merged and short tables, by metric."""
    read = {s: master(spark, d, s).agg(F.count(F.lit(1)).alias("value")).select(F.lit(f"{s}_input_rows").alias("metric"), "value") for s in MAPPERS}
    u = _union(spark, d).select("source_name", F.when(F.col("peptide_length").isin(2, 3), 1).otherwise(0).alias("short"))
    g = u.groupBy("source_name").agg(F.count(F.lit(1)).alias("m"), F.sum("short").alias("s"))
    per = g.select(F.explode(F.array(F.struct(F.concat(F.lit("merged_source::"), "source_name").alias("metric"), F.col("m").alias("value")), F.struct(F.concat(F.lit("short_source::"), "source_name").alias("metric"), F.col("s").alias("value")))).alias("e")).select("e.*").where("value > 0")
    total = g.agg(F.sum("m").alias("m"), F.sum("s").alias("s")).select(F.explode(F.array(F.struct(F.lit("merged_record_level_rows").alias("metric"), F.col("m").alias("value")), F.struct(F.lit("merged_short_2_3_record_level_rows").alias("metric"), F.col("s").alias("value")))).alias("e")).select("e.*")
    return src.union(*read.values(), per, total)


def _annotated(spark, d, source, mode="strict"):
    return worksets.annotated(master(spark, d, source), source, mode)


WORKSET = ["record_id", "workset_tier", "workset_keep_flag", "workset_exclusion_reasons"]


@query
def biopep_workset(spark, d):
    return _annotated(spark, d, "biopep").select(*WORKSET)


@query
def mbpdb_workset(spark, d):
    return _annotated(spark, d, "mbpdb").select(*WORKSET)


@query
def fermfood_worksets(spark, d):
    """Strict and expanded keeping of the same rows, with the reasons."""
    m = master(spark, d, "fermfood")
    both = worksets.annotated(m, "fermfood").withColumnRenamed("workset_keep_flag", "strict_keep").withColumnRenamed("workset_exclusion_reasons", "reasons").drop("workset_tier")
    return worksets.annotated(both, "fermfood", "expanded").select("row_id", "strict_keep", F.col("workset_keep_flag").alias("expanded_keep"), "reasons")


@query
def biopep_routes(spark, d):
    return worksets.routed(_annotated(spark, d, "biopep"), worksets.ROUTES["biopep"]).select("record_id", "route")


@query
def mbpdb_routes(spark, d):
    return worksets.routed(_annotated(spark, d, "mbpdb"), worksets.ROUTES["mbpdb"]).select("record_id", "route")


def _level(spark, d, source, order):
    return worksets.sequence_level(_annotated(spark, d, source).where("workset_keep_flag = 1"), source, order)


@query
def biopep_sequence_level(spark, d):
    return _level(spark, d, "biopep", "ord")


@query
def mbpdb_sequence_level(spark, d):
    return _level(spark, d, "mbpdb", "ord")


@query
def fermfood_sequence_level(spark, d):
    return _level(spark, d, "fermfood", "ord")


@query
def length_consistency(spark, d):
    """Actual against declared length, which stands in for a missing one."""
    t = table(spark, d, "fermfoodb_ace_detail").select("row_id", F.length(tx.clean_sequence(F.col("peptide_sequence"))).alias("n"), F.floor(to_float(F.col("length_of_peptide"))).cast("int").alias("declared"))
    n = F.coalesce("n", "declared")
    return t.select("row_id", n.alias("peptide_length"), "declared", rules.length_consistency(n, F.col("declared")).alias("flag"))


@query
def exact_value_counts(spark, d):
    """Every record with the number of records and of distinct exact values of its sequence, and what follows from them."""
    m = master(spark, d, "ahtpdb").select("id", "sequence_clean", F.when(F.col("ic50_exact_flag") == 1, worksets.value_of()).alias("v"))
    g = m.groupBy("sequence_clean").agg(F.count(F.lit(1)).alias("sequence_dup_count"), F.countDistinct("v").alias("exact_unique_count"))
    return m.join(g, "sequence_clean").select("id", "sequence_dup_count", (F.col("sequence_dup_count") > 1).cast("int").alias("is_duplicate_sequence"), "exact_unique_count", (F.col("exact_unique_count") > 1).cast("int").alias("exact_conflict_flag"))


@query
def highconf_records(spark, d):
    """Valid, length-matched, exact records of di- and tripeptides."""
    m = master(spark, d, "ahtpdb")
    flags = [F.col(c) == 1 for c in ("sequence_valid", "len_match", "ic50_exact_flag")]
    return m.where(flags[0] & flags[1] & flags[2] & (F.lower("ic50_type") == "exact") & worksets.value_of().isNotNull() & ((F.col("is_dipeptide") == 1) | (F.col("is_tripeptide") == 1))).select("id", "sequence_clean", F.round("ic50_uM", 6).alias("ic50_uM"))


@query
def unit_conversion(spark, d):
    """The master with mass concentrations converted, and the trace of it."""
    c = ic50.convert_mass_units(master(spark, d, "ahtpdb"))
    return c.select("id", "ic50_type", "ic50_exact_flag", F.round("ic50_uM", 6).alias("ic50_uM"), "unit_conversion_applied", "unit_conversion_from_unit", "unit_conversion_to_unit", "unit_conversion_formula", "unit_conversion_note")


@query
def unit_conversion_log(spark, d):
    log = ic50.conversion_log(ic50.convert_mass_units(master(spark, d, "ahtpdb")))
    return log.withColumns({c: g_text(F.col(c), 12) for c in ("ic50_value", "molwt_value", "ic50_uM")})


def _consensus_input(spark, d):
    return pl.sequence_level(pl.merged_records(assay(spark, d)))


@query
def consensus_position(spark, d):
    """Place of every sequence in the order of the flag consensus."""
    return rel.numbered(pl.flag_consensus(_consensus_input(spark, d)), pl.flag_order(), "position").select("position", "sequence")


@query
def conflict_position(spark, d):
    return rel.numbered(pl.conflicts(_consensus_input(spark, d)), pl.conflict_order(), "position").select("position", "sequence", "conflict_severity")


@query
def short_position(spark, d):
    """Places of the short sequences, by stability class."""
    return rel.numbered(pl.highconf(pl.merged_records(assay(spark, d))), pl.short_order("stability_class"), "position").select("position", "sequence")


@query
def stable_position(spark, d):
    return rel.numbered(pl.stable(pl.merged_records(assay(spark, d))), pl.short_order("activity_tier"), "position").select("position", "sequence", "activity_tier")


#: Field of the master: its names in detail and list. Own value first, then detail, then list.
BACKFILL = {
    "pubmed_id_raw": ("pubmed_id", "pubmed_id"), "title_raw": ("detail_title", "title"), "protein_raw": ("protein_name", "protein"), "food_matrix_raw": ("food_matrix", "food_matrix"),
    "culture_raw": ("starter_culture", "culture"), "hydrolysis_raw": ("hydrolysis", "hydrolysis"), "experiment_raw": ("experiment", "experiment"), "model_raw": ("model", "model"),
    "assay_raw": ("assay_for_activity_measurement", "assay_for_activity_measurement"), "method_of_analysis_raw": ("method_of_analysis", "method_of_analysis"), "mz_ratio_raw": ("mz_ratio", "mz_ratio"),
    "mass_raw": ("mass", "mass"), "detail_url": ("detail_url", "detail_url"), "activity_label_raw": ("activity", "activity"), "ph_raw": ("ph", "ph"), "temperature_raw": ("temperature", "temperature"),
    "incubation_time_raw": ("incubation_time", "incubation_time"), "ic50_raw": ("ic50_raw", "ic50_raw"),
}
LIST_FIELDS = [
    "list_page_no", "list_page_url", "row_no_on_page", "fmdb_id", "detail_url", "pubmed_id", "title", "peptide_sequence", "length_of_peptide", "food_matrix", "protein", "ph", "temperature", "incubation_time",
    "activity", "experiment", "model", "assay_for_activity_measurement", "culture", "hydrolysis", "method_of_analysis", "mz_ratio", "mass", "ic50_raw",
]
DETAIL_FIELDS = [
    "fmdb_id", "detail_url", "detail_title", "pubmed_id", "peptide_sequence", "length_of_peptide", "food_matrix", "protein_name", "ph", "temperature", "incubation_time", "activity", "experiment", "model",
    "assay_for_activity_measurement", "starter_culture", "hydrolysis", "method_of_analysis", "mz_ratio", "mass", "ic50_raw", "detail_text_path", "detail_html_path",
]


def _cleaned(names):
    """The cleaned values of some columns as one array: one expression for all of them."""
    return F.transform(F.array(*names), lambda c: tx.clean_text(c))


def _richest(df, fields):
    """(_key, values): cleaned fields of the row of each id that has most of them; the first of equals."""
    v = df.select(tx.clean_text(F.col("fmdb_id")).alias("_key"), "row_id", once(_cleaned(fields)).alias("v")).where("_key is not null")
    return v.groupBy("_key").agg(F.min_by("v", F.struct(-F.size(F.array_compact("v")), "row_id")).alias("v"))


def backfilled(rows, key, detail, lst):
    """The rows with each of the eighteen fields from themselves, the richest detail or the richest list row, and ``<f>_filled``."""
    kept = [c for c in rows.columns if c not in BACKFILL]
    own = rows.select(*kept, once(_cleaned(BACKFILL)).alias("_own"), tx.clean_text(F.col(key)).alias("_key"))
    j = own.join(_richest(detail, DETAIL_FIELDS).withColumnRenamed("v", "_d"), "_key", "left").join(_richest(lst, LIST_FIELDS).withColumnRenamed("v", "_l"), "_key", "left")
    out = []
    for i, (f, (in_detail, in_list)) in enumerate(BACKFILL.items()):
        mine, other = F.get("_own", F.lit(i)), F.coalesce(F.get("_d", F.lit(DETAIL_FIELDS.index(in_detail))), F.get("_l", F.lit(LIST_FIELDS.index(in_list))))
        out += [F.coalesce(mine, other).alias(f), (mine.isNull() & other.isNotNull()).cast("int").alias(f"{f}_filled")]
    return j.select(*kept, *out)


@query
def master_backfill(spark, d):
    """Eighteen fields of the master from detail and list, with what was filled."""
    t = table(spark, d, "fermfoodb_ace_master_clean").select("row_id", "source_record_id", *BACKFILL)
    return backfilled(t, "source_record_id", table(spark, d, "fermfoodb_ace_detail"), table(spark, d, "fermfoodb_ace_list")).drop("source_record_id")


@query
def backfill_report(spark, d):
    """Per field how many values were there before, how many came, and how many there are."""
    f = master_backfill(spark, d)
    one = f.agg(*[F.sum(f"{c}_filled").alias(f"{c}_g") for c in BACKFILL], *[F.count(c).alias(f"{c}_n") for c in BACKFILL])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), (F.col(f"{c}_n") - F.col(f"{c}_g")).alias("n_before"), F.col(f"{c}_g").alias("n_gain"), F.col(f"{c}_n").alias("n_after")) for c in BACKFILL])).alias("x")).select("x.*")


def _pages(spark, d):
    """Texts and markup of report and list pages, made of the parts."""
    return spark.sql(PAGES.replace("{div}", "div").replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))


@query
def bibliography(spark, d):
    return _pages(spark, d).select("p_partkey", once(tx.bibliography(F.col("biblio"))).alias("b")).select("p_partkey", "b.*")


@query
def report_fields(spark, d):
    return _pages(spark, d).select("p_partkey", *[c.alias(n) for n, c in tx.report_fields(F.col("report")).items()])


@query
def list_text_rows(spark, d):
    return _pages(spark, d).select("p_partkey", F.explode(tx.list_rows_of_text(F.col("list_text"))).alias("r")).select("p_partkey", "r.*")


@query
def list_html_rows(spark, d):
    return _pages(spark, d).select("p_partkey", F.explode(tx.list_rows_of_html(F.col("list_html"))).alias("r")).select("p_partkey", "r.*")


@query
def activity_cells(spark, d):
    return _pages(spark, d).select("p_partkey", once(tx.activity_cell(F.col("cell"))).alias("c")).select("p_partkey", "c.*")


@query
def page_totals(spark, d):
    return _pages(spark, d).select("p_partkey", tx.total_pages(F.col("list_text")).alias("pages"), tx.total_entries(F.col("report")).alias("entries"))


@query
def page_candidates(spark, d):
    t = table(spark, d, "fermfoodb_ace_list").select("list_page_url", F.coalesce(F.col("list_page_no").try_cast("int"), F.lit(1)).alias("page")).where("list_page_url is not null").distinct()
    return t.select("list_page_url", "page", F.explode(tx.page_candidates(F.col("list_page_url"), F.col("page"))).alias("candidate"))


@query
def activity_filter(spark, d):
    """List rows of the one activity that is crawled."""
    name = tx.normalize_spaces(F.col("activity"))
    return table(spark, d, "fermfoodb_ace_list").where(F.lower(name) == "ace inhibitory").select("row_id", name.alias("activity"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
