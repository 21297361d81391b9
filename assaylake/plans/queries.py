"""One query per operator family of the survey. Each reads whole tables; see oracles.py for the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylake.functions import features, ic50, numeric, rules
from assaylake.functions import text as tx
from assaylake.functions.plain import once
from assaylake.operators import classify as svm
from assaylake.operators import orphans
from assaylake.operators import relational as rel
from assaylake.plans import pipelines as pl
from assaylake.plans import worksets
from assaylake.plans.fixtures import assay
from assaylake.plans.oracles import ORACLES
from assaylake.session import cut_lineage, table
from assaylake.sources import html as page

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _r6(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c.split(".")[-1])


def _parsed(p: str = "p"):
    return [F.col(f"{p}.status").alias("status"), F.col(f"{p}.relation").alias("relation"), _r6(f"{p}.value"), F.col(f"{p}.unit").alias("unit"), _r6(f"{p}.um")]


# --- parsers -----------------------------------------------------------------------------------------------


ROW = ["l_orderkey", "l_linenumber"]


@query
def ic50_ahtpdb(spark, d):
    a = ic50.with_reading(assay(spark, d).select(*ROW, "ic50_raw"), "AHTPDB")
    return a.select(*ROW, *_parsed(), _r6("p.low"), _r6("p.high"), F.col("p.exact").alias("exact"))


@query
def ic50_biopep(spark, d):
    return ic50.with_reading(assay(spark, d).select(*ROW, "ic50_raw"), "BIOPEP").select(*ROW, *_parsed())


def _fermfood(spark, d, advanced):
    t = table(spark, d, "fermfoodb_ace_master_clean").select("row_id", "ic50_raw", "mass_da")
    return ic50.with_reading(t, "advanced" if advanced else "FermFooDb", mass=F.col("mass_da")).select("row_id", *_parsed())


@query
def ic50_fermfood(spark, d):
    return _fermfood(spark, d, False)


@query
def ic50_fermfood_advanced(spark, d):
    return _fermfood(spark, d, True)


@query
def ic50_mbpdb(spark, d):
    a = ic50.with_reading(assay(spark, d).select(*ROW, "ic50_raw"), "MBPDB")
    return a.select(*ROW, *_parsed(), _r6("p.low"), _r6("p.high"))


@query
def ic50_from_text(spark, d):
    t = table(spark, d, "documents").select("doc_id", once(ic50.parse_detail_text(F.coalesce("text", F.lit("")))).alias("p"))
    return t.select("doc_id", *_parsed())


@query
def ic50_type_distribution(spark, d):
    p = ic50.with_reading(assay(spark, d).select("ic50_raw"), "AHTPDB").groupBy(F.col("p.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return rel.share_of_total(p)


@query
def unit_mass_to_um(spark, d):
    a = ic50.with_reading(assay(spark, d).select("l_partkey", "ic50_raw"), "AHTPDB").where("p.status = 'mass_unit'")
    w = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")).alias("molwt"))
    j = a.join(w, a.l_partkey == w.p_partkey, "left")
    um = ic50.mass_to_um(F.col("p.status"), F.col("p.relation"), F.col("p.value"), F.col("p.unit"), F.col("molwt"))
    return j.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.count(um).alias("n_converted"), F.round(F.sum(um), 3).alias("um_sum"))


@query
def context_rescue(spark, d):
    """Bare numbers count as micromolar where two resolved records share the sequence, whatever their values."""
    t = table(spark, d, "fermfoodb_ace_master_rescued").select("row_id", tx.clean_sequence(F.col("sequence")).alias("seq"), tx.clean_text(F.col("ic50_parse_status")).alias("st"), "ic50_raw", worksets.value_of().alias("um"))
    ctx = t.where("seq is not null and st in ('exact_molar', 'molar_threshold') and um is not null").groupBy("seq").agg(
        F.count(F.lit(1)).alias("n_context"), *[F.round(f("um"), 6).alias(f"context_{n}") for n, f in (("median", F.median), ("min", F.min), ("max", F.max))]
    )
    bare = t.where("st = 'numeric_no_unit'").select("row_id", "seq", once(numeric.median_of(numeric.numbers_in(F.coalesce(tx.clean_text(F.col("ic50_raw")), F.lit(""))))).alias("v"))
    j = bare.join(ctx, "seq", "left")
    return j.select("row_id", "seq", F.round(F.when(F.col("n_context") >= 2, F.col("v")), 6).alias("rescued_um"), "n_context", "context_median", "context_min", "context_max")


# --- text and numbers --------------------------------------------------------------------------------------


@query
def clean_text_tokens(spark, d):
    t = table(spark, d, "fermfoodb_ace_list")
    return t.select("row_id", *[tx.clean_text(F.col(c)).alias(c) for c in ("ph", "temperature", "incubation_time", "culture")])


@query
def year_extract(spark, d):
    t = table(spark, d, "documents").select("doc_id", tx.year_latest(F.col("text")).alias("latest"), tx.year_earliest(F.col("text"), F.col("pubmed_id")).alias("earliest"), tx.year_from_digits(F.col("pubmed_id")).alias("digits"))
    return t.where("latest is not null or earliest is not null or digits is not null")


@query
def number_coercion(spark, d):
    t = table(spark, d, "fermfoodb_ace_detail")
    return t.select("row_id", _f(numeric.to_float(F.col("ph")), "ph"), _f(numeric.to_float(F.col("mass")), "mass"), numeric.to_int(F.col("length_of_peptide")).alias("len"))


def _f(c, name):
    return F.round(c, 6).alias(name)


@query
def mass_from_text(spark, d):
    t = table(spark, d, "fermfoodb_ace_detail")
    return t.select("row_id", _f(numeric.mass_of_text(tx.clean_text(F.col("mass")), tx.clean_text(F.col("mz_ratio"))), "mass_da"))


@query
def six_digits(spark, d):
    t = table(spark, d, "ace_short_2_3_merged_sequence_level_v0_3").where("ic50_uM_mean > 0 and not isnan(ic50_uM_mean)")
    return t.select("row_id", F.round(numeric.sig6(F.col("ic50_uM_mean")), 9).alias("sig6"))


@query
def canonical_sequence_filter(spark, d):
    t = table(spark, d, "fermfoodb_ace_detail").select("row_id", tx.clean_sequence(F.col("peptide_sequence")).alias("seq"))
    return t.where(tx.is_canonical(F.col("seq"))).select("row_id", "seq", F.length("seq").alias("len"))


@query
def terminal_residues(spark, d):
    t = table(spark, d, "fermfoodb_ace_detail").select("row_id", tx.clean_sequence(F.col("peptide_sequence")).alias("seq")).where(tx.is_canonical(F.col("seq")))
    n = F.length("seq")
    return t.select("row_id", F.left("seq", F.lit(1)).alias("n_term"), F.right("seq", F.lit(1)).alias("c_term"), F.reverse("seq").alias("rev"), (n == 2).cast("int").alias("is_di"), (n == 3).cast("int").alias("is_tri"))


@query
def natural_key(spark, d):
    t = table(spark, d, "fermfoodb_ace_list")
    return t.select("row_id", F.concat_ws("_", F.lit("FMDB"), tx.slug(tx.clean_text(F.col("protein"))), tx.clean_sequence(F.col("peptide_sequence")), tx.slug(tx.clean_text(F.col("ph")))).alias("key"))


@query
def safe_file_name(spark, d):
    return table(spark, d, "fermfoodb_ace_list").select("row_id", tx.safe_name(F.col("detail_url")).alias("name"))


@query
def url_canonical(spark, d):
    return table(spark, d, "fermfoodb_ace_list").select("row_id", tx.canonical_url(F.col("list_page_url")).alias("list_url"), tx.canonical_url(F.col("detail_url")).alias("detail_url"))


# What a page of the crawl is searched for.
PAGE_WORDS = ["peptide", "activity", "ic50", "function", "matrix", "culture", "protein", "fermentation", "hydrolysis"]


@query
def page_keyword_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.keyword_hits(F.coalesce("text", F.lit("")), PAGE_WORDS), " | ").alias("hits"))


@query
def page_class(spark, d):
    """Documents by their text, as pages without URL and title."""
    none = F.lit(None).cast("string")
    return table(spark, d, "documents").select("doc_id", tx.page_class(none, none, F.col("text")).alias("page_class"))


@query
def page_class_of_urls(spark, d):
    t = table(spark, d, "fermfoodb_ace_list")
    return t.select("row_id", tx.page_class(F.col("list_page_url"), F.col("title"), F.col("experiment")).alias("list_page"), tx.page_class(F.col("detail_url"), F.col("title"), F.col("ic50_raw")).alias("detail_page"))


# The labels of a card.
LABELS = ["Entry:", "Name:", "Sequence:", "Number of residues:", "Monoisotopic mass:", "IC50 :", "Activity:", "Source:", "Assay:", "Additional information:"]


@query
def section_extract(spark, d):
    t = table(spark, d, "documents").where("doc_kind = 'card'")
    return t.select("doc_id", *[tx.section(F.col("text"), s, LABELS).alias(n) for n, s in (("activity", "Activity:"), ("assay", "Assay:"), ("information", "Additional information:"))])


@query
def notes_edit(spark, d):
    t = table(spark, d, "fermfoodb_ace_parse_log")
    return t.select("log_id", tx.edit_notes(F.col("notes"), [F.when(F.col("ic50_uM").isNull(), "um_open"), "reviewed"], ["ic50_needs_manual_review"]).alias("notes"))


@query
def compose_labels(spark, d):
    t = table(spark, d, "fermfoodb_ace_detail")
    parts = [tx.clean_text(F.col(c)) for c in ("activity", "experiment", "activity", "model")]
    value, assay_name = tx.clean_text(F.col("ic50_raw")), tx.clean_text(F.col("assay_for_activity_measurement"))
    raw = F.when(assay_name.isNotNull(), F.concat(value, F.lit(" ["), assay_name, F.lit("]"))).otherwise(value)
    return t.select("row_id", F.array_join(F.array_distinct(F.array_compact(F.array(*parts))), " | ").alias("label"), raw.alias("composed"))


# --- joins and dedupes -------------------------------------------------------------------------------------


def _lists(spark, d):
    lst = table(spark, d, "fermfoodb_ace_list").withColumn("num", orphans.fmdb_number(F.col("fmdb_id")))
    det = table(spark, d, "fermfoodb_ace_detail").withColumn("num", orphans.fmdb_number(F.col("fmdb_id")))
    return lst, det


@query
def keep_first_dedupe(spark, d):
    lst, _ = _lists(spark, d)
    return rel.keep_first(lst.select("num", "row_id", "ph", "mass"), "num", F.col("row_id"))


@query
def keep_last_dedupe(spark, d):
    _, det = _lists(spark, d)
    return rel.keep_last(det.select("num", "row_id", "ph", "mass"), "num", F.col("row_id"))


RICH = ["ph", "temperature", "incubation_time", "activity", "mass", "mz_ratio", "ic50_raw"]


@query
def richest_row_dedupe(spark, d):
    _, det = _lists(spark, d)
    return rel.keep_richest(det.select("num", "row_id", *RICH), "num", F.col("row_id"), RICH).select("num", "row_id", "dup_count")


@query
def left_backfill(spark, d):
    """First list row and first detail row per id; list values first, details behind."""
    lst, det = _lists(spark, d)
    a = rel.keep_first(lst.select("num", "row_id", "ph", "mass"), "num", F.col("row_id"), keep_null=True)
    b = rel.keep_first(det.select("num", "row_id", F.col("ph").alias("d_ph"), F.col("mass").alias("d_mass")), "num", F.col("row_id")).drop("row_id", "dup_count")
    return a.join(b, "num", "left").select("num", tx.first_clean(F.col("ph"), F.col("d_ph")).alias("ph"), tx.first_clean(F.col("mass"), F.col("d_mass")).alias("mass"))


@query
def full_outer_provenance(spark, d):
    lst, det = _lists(spark, d)
    a = rel.keep_last(lst.select("num", "row_id"), "num", F.col("row_id")).select("num", F.col("row_id").alias("list_row"))
    b = rel.keep_last(det.select("num", "row_id"), "num", F.col("row_id")).select("num", F.col("row_id").alias("detail_row"))
    src = F.when(F.col("list_row").isNotNull() & F.col("detail_row").isNotNull(), "list+detail").when(F.col("list_row").isNotNull(), "list_only").otherwise("detail_only")
    return a.join(b, "num", "full").withColumn("merge_source", src)


@query
def list_detail_fusion(spark, d):
    """All list rows with the richest detail: detail values first, ids and URLs from the list."""
    lst, det = _lists(spark, d)
    cols = ["detail_url", "activity", "mass", "ic50_raw"]
    b = rel.keep_richest(det.select("num", "row_id", *RICH, "detail_url"), "num", F.col("row_id"), RICH).select("num", *[F.col(c).alias(f"d_{c}") for c in cols])
    j = lst.select("num", "row_id", *cols).join(b, "num", "left")
    return j.select("row_id", tx.first_clean(F.col("detail_url"), F.col("d_detail_url")).alias("detail_url"), *[tx.first_clean(F.col(f"d_{c}"), F.col(c)).alias(c) for c in cols[1:]])


@query
def backfill_flags(spark, d):
    """Own value, then detail's, and whether it was filled."""
    lst, det = _lists(spark, d)
    b = rel.keep_richest(det.select("num", "row_id", *RICH), "num", F.col("row_id"), RICH).select("num", F.col("ph").alias("d_ph"), F.col("temperature").alias("d_temperature"))
    j = lst.select("num", "row_id", "ph", "temperature").join(b, "num", "left")
    cols = []
    for c in ("ph", "temperature"):
        own, other = tx.clean_text(F.col(c)), tx.clean_text(F.col(f"d_{c}"))
        cols += [F.coalesce(own, other).alias(c), (own.isNull() & other.isNotNull()).cast("int").alias(f"{c}_filled")]
    return j.select("row_id", *cols)


@query
def backfill_gain(spark, d):
    f = backfill_flags(spark, d)
    return f.agg(F.count(F.lit(1)).alias("total"), *[F.sum(f"{c}_filled").alias(f"{c}_gain") for c in ("ph", "temperature")], *[F.count(c).alias(f"{c}_after") for c in ("ph", "temperature")])


@query
def status_before_after(spark, d):
    """Both counts from one pass: every row speaks for its stored and for its new status."""
    t = table(spark, d, "fermfoodb_ace_master_clean").select(tx.clean_text(F.col("ic50_parse_status")).alias("before"), "ic50_raw", "mass_da")
    t = ic50.with_reading(t, "FermFooDb", mass=F.col("mass_da"))
    both = t.select(F.explode(F.array(F.struct(F.coalesce("before", F.lit("none")).alias("status"), F.lit(1).alias("b")), F.struct(F.col("p.status").alias("status"), F.lit(0).alias("b")))).alias("e")).select("e.*")
    return both.groupBy("status").agg(F.count_if(F.col("b") == 1).alias("n_before"), F.count_if(F.col("b") == 0).alias("n_after"))


@query
def status_upgrade(spark, d):
    """The master with the improved rules' reading wherever it is better: all its fields change together."""
    t = table(spark, d, "fermfoodb_ace_master_clean").select("row_id", "ic50_raw", "mass_da", "ic50_relation", "ic50_unit", "ic50_parse_status", worksets.value_of("ic50_value").alias("v"), worksets.value_of().alias("um"))
    t = ic50.with_reading(t, "advanced", mass=F.col("mass_da"))
    t = t.withColumn("up", once(ic50.better(F.col("p.status"), F.col("p.um"), tx.clean_text(F.col("ic50_parse_status")), F.col("um"))))
    swap = lambda new, old, name: F.when(F.col("up"), F.col(new)).otherwise(F.col(old)).alias(name)
    return t.select("row_id", F.col("up").cast("int").alias("changed"), swap("p.status", "ic50_parse_status", "status"), swap("p.relation", "ic50_relation", "relation"), swap("p.unit", "ic50_unit", "unit"), F.round(swap("p.value", "v", "value"), 6).alias("value"), F.round(swap("p.um", "um", "um"), 6).alias("um"))


@query
def detail_text_upgrade(spark, d):
    """Which stored readings of the log a resolved reading of the same text replaces by the guard of detail texts."""
    t = table(spark, d, "fermfoodb_ace_parse_log").select("log_id", "ic50_parse_status", worksets.value_of().alias("um"), tx.clean_text(F.col("ic50_unit")).alias("u"), "ic50_raw", "mass_da")
    t = ic50.with_reading(t, "advanced", mass=F.col("mass_da"))
    return t.where(ic50.stronger(F.col("p.status"), tx.clean_text(F.col("ic50_parse_status")), F.col("um"), F.col("u"), F.col("p.unit"))).select("log_id", F.col("p.status").alias("status"), _r6("p.um"))


@query
def append_unique(spark, d):
    old = table(spark, d, "supplier").select(F.concat(F.lit("k"), (F.col("s_suppkey") * 2).cast("string")).alias("source_id"), F.format_string("src_%03d", F.col("s_suppkey") + 1).alias("catalog_id"))
    new = table(spark, d, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("source_id"), "n_name")
    return rel.append_unique(old, new, "source_id", "catalog_id", "src")


# --- merged records, sequence level, consensus -------------------------------------------------------------


def _records(spark, d):
    return pl.merged_records(assay(spark, d))


def _level(spark, d):
    return pl.sequence_level(_records(spark, d))


@query
def merge_union_sources(spark, d):
    return _records(spark, d).groupBy("source_name", "status", "relation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("um"), 3).alias("um_sum"))


@query
def sequence_level(spark, d):
    return _level(spark, d)


@query
def stability_flag(spark, d):
    return _level(spark, d).groupBy("stability_flag").agg(F.count(F.lit(1)).alias("n"))


@query
def per_source_sequence_level(spark, d):
    r = _records(spark, d).groupBy("source_name", "sequence").agg(F.count(F.lit(1)).alias("n"), F.min("um").alias("um_min"), F.max("um").alias("um_max"), F.round(F.median("um"), 6).alias("um_median"))
    ratio = F.round(numeric.spread(F.col("um_min"), F.col("um_max")), 6)
    return r.withColumn("ratio", ratio).withColumn("flag", rules.stability_flag(F.lit(1), F.col("n"), F.col("ratio")))


@query
def consensus_tier(spark, d):
    c = pl.consensus(_level(spark, d))
    return c.select("sequence", "peptide_length", "source_count", "record_count_total", "ic50_uM_median", pl.RATIO, "stability_flag", "consensus_tier", "consensus_score", "high_confidence_flag", "conflict_flag", "source_richness_flag")


@query
def consensus_top(spark, d):
    """The first hundred in consensus order (a top-k report)."""
    return pl.consensus(_level(spark, d)).orderBy(*pl.consensus_order()).limit(100).select("sequence", "consensus_tier", "consensus_score")


@query
def consensus_abcx(spark, d):
    return pl.flag_consensus(_level(spark, d)).select("sequence", "consensus_tier", "consensus_rank", "consensus_keep_flag", "priority_score", "consensus_note")


@query
def conflict_detail(spark, d):
    return pl.conflicts(_level(spark, d)).select("sequence", "source_count", "record_count_total", pl.RATIO, "conflict_reason", "conflict_severity")


@query
def stored_consensus(spark, d):
    """Tiers and scores of the stored sequence-level table."""
    t = table(spark, d, "ace_short_2_3_merged_sequence_level_v0_3")
    nan_free = {c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in (pl.RATIO, "ic50_uM_median")}
    return pl.consensus(t.withColumns(nan_free)).select("row_id", "consensus_tier", "consensus_score")


def _exact_values(spark, d):
    """Per sequence the distinct exact values as texts of six digits, and the sources and assays behind all its records."""
    a = assay(spark, d).select("record_id", "sequence", "ic50_raw", "assay", "source_name")
    r = ic50.with_reading(a, "AHTPDB")
    exact = F.when((F.col("p.exact") == 1) & F.col("p.um").isNotNull(), numeric.g_text(F.col("p.um")))
    sets = {"v": exact, "sources": F.col("source_name"), "assays": F.col("assay"), "ids": F.col("record_id")}
    return r.groupBy("sequence").agg(F.count(F.lit(1)).alias("dup_count"), *[F.array_sort(F.collect_set(c)).alias(n) for n, c in sets.items()]).where(F.size("v") >= 2)


@query
def exact_conflicts(spark, d):
    """Sequences of several exact values, which are told apart and sorted as texts."""
    c = _exact_values(spark, d)
    return c.select("sequence", "dup_count", F.size("v").alias("n_values"), *[F.array_join(n, " | ").alias(f"{n}_list") for n in ("v", "sources", "assays", "ids")])


@query
def conflict_source_assay(spark, d):
    c = _exact_values(spark, d)
    return c.select(
        "sequence", F.array_join("v", " | ").alias("v_list"), F.size("sources").alias("n_sources"), F.array_join("sources", " | ").alias("sources_list"), F.size("assays").alias("n_assays"),
        F.array_join("assays", " | ").alias("assays_list"), (F.size("sources") >= 2).cast("int").alias("cross_source"), (F.size("assays") >= 2).cast("int").alias("cross_assay"),
    )


@query
def benchmark_bucket(spark, d):
    return pl.benchmark(pl.consensus(_level(spark, d)))


@query
def highconf_aggregate(spark, d):
    return pl.highconf(_records(spark, d))


@query
def stable_activity_tier(spark, d):
    return pl.stable(_records(spark, d)).groupBy("activity_tier").agg(F.count(F.lit(1)).alias("n"))


@query
def label_grade(spark, d):
    p = ic50.with_reading(assay(spark, d).select("sequence", "ic50_raw"), "AHTPDB")
    g = rules.label_grade(tx.is_canonical(F.col("sequence")).cast("int"), F.lit(1), F.col("p.exact"), F.col("p.status"), F.col("p.um"))
    n = p.select(g.alias("grade"), F.length("sequence").alias("len")).groupBy("grade").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("len") == 2).alias("n_di"), F.count_if(F.col("len") == 3).alias("n_tri"))
    return rel.share_of_total(rel.zero_filled(n, {"grade": ["A", "B", "C"]}, "n").fillna(0))


@query
def multiplicity_histogram(spark, d):
    return rel.multiplicity_histogram(_records(spark, d), "sequence")


@query
def null_profile(spark, d):
    return rel.null_profile(table(spark, d, "fermfoodb_ace_list"))


@query
def duplicate_check(spark, d):
    lst, _ = _lists(spark, d)
    return lst.where("num is not null").groupBy("num").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query
def length_by_layer(spark, d):
    """Lengths 1 to 20 in the layers of a peptide table, zeros included, with the share of the layer."""
    n = F.length(tx.clean_sequence(F.col("sequence")))
    t = table(spark, d, "fermfoodb_ace_master_clean").select(n.alias("len"), (tx.clean_text(F.col("ic50_parse_status")) == "exact_molar").alias("exact"), worksets.value_of().alias("um"))
    layers = {"all": F.lit(True), "exact": F.col("exact"), "strong": F.col("exact") & (F.col("um") <= 50)}
    each = t.where("len is not null").select("len", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in layers.items()]))).alias("layer"))
    counts = each.groupBy("layer", "len").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("layer"))
    full = counts.select("layer", "len").unionByName(rel.zero_filled(counts.limit(0).select("layer", "len", "n"), {"layer": list(layers), "len": list(range(1, 21))}, "n").select("layer", "len")).distinct()
    filled = full.join(counts, ["layer", "len"], "left").fillna(0, ["n"])
    return filled.withColumn("share", F.round(F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)), 6))


@query
def group_counts(spark, d):
    """Dipeptides and tripeptides by overlapping activity groups, and the sizes of the layers."""
    h = pl.highconf(_records(spark, d))
    groups = {"all": F.lit(True), "stable": F.col("stability_class") == "stable", "strong": F.col("activity_tier") == "strong", "stable_strong": (F.col("stability_class") == "stable") & (F.col("activity_tier") == "strong"), "weak": F.col("activity_tier") == "weak"}
    one = h.agg(*[F.count_if(c & (F.col("peptide_length") == n)).alias(f"{g}_{n}") for g, c in groups.items() for n in (2, 3)], *[F.coalesce(F.sum(F.when(c, F.col("record_count"))), F.lit(0)).alias(f"{g}_r") for g, c in groups.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(g).alias("grp"), F.col(f"{g}_2").alias("n_di"), F.col(f"{g}_3").alias("n_tri"), F.col(f"{g}_r").alias("n_records")) for g in groups])).alias("x")).select("x.*")


@query
def fold_bins(spark, d):
    """Sequences by fold of their exact values; only bins that occur."""
    h = pl.highconf(_records(spark, d))
    return rel.share_of_total(h.groupBy(rules.fold_bin(F.col("fold")).alias("bin")).agg(F.count(F.lit(1)).alias("n")))


@query
def spread_buckets(spark, d):
    return _level(spark, d).groupBy(rules.spread_bucket(F.col(pl.RATIO)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query
def high_conflicts(spark, d):
    """Sequences that are not stable or vary more than threefold."""
    h = pl.highconf(_records(spark, d)).where("stability_class <> 'stable' or fold > 3")
    return h.select("sequence", "record_count", "n_unique", "um_min", "um_max", "um_median", "fold", "stability_class", "source_count", "assay_count", "source_list", "assay_list")


PEPTIDE_TYPES = {"di": 2, "tri": 3}


def _ends(spark, d):
    """(term, type, strong, residue): both ends of the stable sequences."""
    s = pl.stable(_records(spark, d))
    kind = F.when(F.col("peptide_length") == 2, "di").otherwise("tri")
    ends = F.array(F.struct(F.lit("N").alias("term"), F.left("sequence", F.lit(1)).alias("residue")), F.struct(F.lit("C").alias("term"), F.right("sequence", F.lit(1)).alias("residue")))
    return s.select(kind.alias("type"), (F.col("activity_tier") == "strong").alias("strong"), F.explode(ends).alias("e")).select("type", "strong", "e.*")


@query
def terminal_freq(spark, d):
    """Residues at both ends in the four groups all or strong, dipeptides or tripeptides."""
    e = _ends(spark, d)
    grouped = e.select("term", "residue", F.explode(F.array_compact(F.array(F.concat(F.lit("all-"), "type"), F.when(F.col("strong"), F.concat(F.lit("strong-"), "type"))))).alias("grp"))
    return rel.residue_shares(grouped, "residue", {"term": ["N", "C"], "grp": ["all-di", "all-tri", "strong-di", "strong-tri"]})


def _places(spark, d):
    """(type, place, strong, residue): every residue of the stable sequences, by peptide type and position."""
    s = pl.stable(_records(spark, d))
    kind = F.when(F.col("peptide_length") == 2, "di").otherwise("tri")
    p = rel.residues(s.select("sequence", kind.alias("type"), (F.col("activity_tier") == "strong").alias("strong")), "sequence", ["type", "strong"])
    return p.select(F.concat("type", F.col("position").cast("string")).alias("place"), "strong", "residue")


PLACES = {"place": ["di1", "di2", "tri1", "tri2", "tri3"]}


@query
def position_freq(spark, d):
    return rel.residue_shares(_places(spark, d), "residue", PLACES)


@query
def position_enrichment(spark, d):
    return rel.enrichment(_places(spark, d), "residue", F.col("strong"), PLACES)


@query
def terminal_enrichment(spark, d):
    return rel.enrichment(_ends(spark, d), "residue", F.col("strong"), {"term": ["N", "C"]})


@query
def topk_enriched(spark, d):
    """The fifteen residues of strongest enrichment or depletion at each end (a top-k report); equals in alphabet order."""
    e = terminal_enrichment(spark, d)
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.abs("log2fc").desc(), "residue"))
    return e.withColumn("rank", rank).where("rank <= 15").select("term", "rank", "residue", "log2fc")


@query
def reverse_exists(spark, d):
    s = _records(spark, d).select("sequence").distinct()
    return s.join(s.select(F.reverse("sequence").alias("sequence"), F.lit(1).alias("hit")), "sequence", "left").select("sequence", F.coalesce("hit", F.lit(0)).alias("reverse_exists_flag"))


@query
def reverse_pairs(spark, d):
    """Stable sequences whose reverse is stable too, with the verdict which of both is stronger."""
    p = rel.reverse_pairs(pl.stable(_records(spark, d)), "sequence", ["um_median", "activity_tier", "peptide_length"])
    a, b = F.col("um_median_a"), F.col("um_median_b")
    ok = (a > 0) & (b > 0)
    return p.select(
        "seq_a", "seq_b", F.when(F.col("peptide_length_a") == 2, "di").otherwise("tri").alias("type"), a.alias("value_a"), b.alias("value_b"),
        F.when(ok, numeric.sig6(F.greatest(a, b) / F.least(a, b))).alias("fold"), F.round(F.when(ok, F.abs(F.log10(a) - F.log10(b))), 6).alias("log_gap"),
        F.when(~ok, "undecided").when(F.abs(a - b) < 1e-12, "tie").when(a < b, F.col("seq_a")).otherwise(F.col("seq_b")).alias("stronger"),
        F.col("activity_tier_a").alias("tier_a"), F.col("activity_tier_b").alias("tier_b"), ((F.col("activity_tier_a") == "strong") & (F.col("activity_tier_b") == "strong")).cast("int").alias("both_strong"),
    )


@query
def metric_summary(spark, d):
    return rel.metric_summary(table(spark, d, "fermfoodb_ace_master_clean").select("source_name", "ic50_relation", "source_type"), ["source_name", "ic50_relation", "source_type"])


@query
def merged_ids(spark, d):
    """Sequential ids in the order length, sequence."""
    s = _level(spark, d).select("peptide_length", "sequence")
    return rel.numbered(s, [F.col("peptide_length"), F.col("sequence")], "n").select("sequence", F.format_string("ace_merged_%06d", F.col("n")).alias("merged_id"))


@query
def rare_class_filter(spark, d):
    t = table(spark, d, "fermfoodb_ace_detail").select(tx.clean_sequence(F.col("peptide_sequence")).alias("seq"), tx.clean_text(F.col("activity")).alias("label")).where("seq is not null and label is not null").distinct()
    return t.join(t.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n >= 2"), "label").select("seq", "label")


# --- features ----------------------------------------------------------------------------------------------


def _peptides(spark, d):
    return canonical_sequence_filter(spark, d).select("seq").distinct()


@query
def mass_from_sequence(spark, d):
    return _peptides(spark, d).select("seq", F.round(numeric.mass_of_sequence(F.col("seq")), 5).alias("mass"))


@query
def aac_features(spark, d):
    c = _peptides(spark, d).select("seq", features.composition(F.col("seq")).alias("v"))
    return c.select("seq", F.posexplode("v").alias("i", "x")).select("seq", "i", F.round("x", 6).alias("x"))


@query
def signal_moments(spark, d):
    c = _peptides(spark, d).select("seq", once(features.signal(F.col("seq"), features.HYDRO)).alias("x")).select("seq", features.moments(F.col("x")).alias("m"))
    return c.select("seq", *[F.round(F.get("m", i), 6).alias(n) for i, n in enumerate(("mean", "std", "least", "greatest", "energy"))])


@query
def fft_features(spark, d):
    v = features.with_signal_features(_peptides(spark, d), "seq", "v")
    return v.select("seq", F.posexplode("v").alias("i", "x")).select("seq", "i", F.round("x", 6).alias("x"))


# --- pages, classification ------------------------


def _pages(spark, d):
    """Stored pages made of the list rows: one page per list page, with a table and a link per entry."""
    t = table(spark, d, "fermfoodb_ace_list").select("list_page_url", "row_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("fmdb_id", "peptide_sequence", "ic50_raw", "detail_url")])
    esc = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    row = F.concat(F.lit("<tr><td><a href='"), esc("detail_url"), F.lit("'>"), esc("fmdb_id"), F.lit("</a></td><td>"), esc("peptide_sequence"), F.lit("</td><td>"), esc("ic50_raw"), F.lit("</td></tr>"))
    per = t.select("list_page_url", F.struct("row_id", row.alias("r")).alias("x")).groupBy("list_page_url").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    body = F.array_join(F.transform("xs", lambda x: x["r"]), "")
    return per.select(F.col("list_page_url").alias("url"), F.concat(F.lit("<html><body>Page 1 of 3<table><tr><th>FMDB ID</th><th>Sequence</th><th>IC50</th></tr>"), body, F.lit("</table></body></html>")).alias("html"))


@query
def html_table_extract(spark, d):
    return page.table_rows(_pages(spark, d), "url", "html", ["FMDB ID", "Sequence", "IC50"])


@query
def html_to_text(spark, d):
    return _pages(spark, d).select("url", tx.html_to_text(F.col("html")).alias("text"))


@query
def page_links(spark, d):
    return _pages(spark, d).select("url", F.explode(page.links_of(F.col("html"))).alias("l")).select("url", "l.href", "l.label")


@query
def page_crawl(spark, d):
    """All list pages as seeds, and what they link to."""
    pages = _pages(spark, d)
    return page.crawl(pages, pages.select("url"), 2, "fermfood.example")


@query
def svm_cv(spark, d):
    """Out-of-fold metrics of the strongest potency tier of stable sequences, in three feature sets."""
    s = pl.stable(_records(spark, d)).select(F.col("sequence").alias("seq"), F.when(F.col("activity_tier") == "strong", "strong").otherwise("other").alias("label"))
    s = features.with_signal_features(svm.encoded(s, "label"), "seq", "fusion")
    s = cut_lineage(s.select("seq", "y", F.slice("fusion", 1, 21).alias("composition"), F.slice("fusion", 22, 41).alias("signal"), "fusion"))
    each = [svm.metrics(svm.cross_validated(s, "y", f, "seq")).select(F.lit(f).alias("features"), "metric", "value") for f in ("composition", "signal", "fusion")]
    return each[0].unionByName(each[1]).unionByName(each[2])


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: q for k, q in ORACLES.items() if k in QUERIES}


__all__ = ["DataFrame", "SparkSession", "queries", "oracle_sql"]
