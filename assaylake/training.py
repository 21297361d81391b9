"""Queries of the general data problems (units, broken rows, orphan references, missing values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.text import MISSING_TOKENS, clean_text
from assaylake.operators import impute, orphans, recover, units
from assaylake.oracles_training import ORACLES
from assaylake.session import table

UNIT_COLUMNS = ["row_id", "source_name", "ic50_raw", "ic50_unit", "mass_raw", "mass_da"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = units.convert_potency(table(spark, sf_dir, "fermfoodb_ace_master_clean").select(*UNIT_COLUMNS))
    other = ~units.is_micromolar(F.col("q_dimension"), F.col("q_factor"))
    return q.where(F.col("q_nm").isNotNull() & other).select("row_id", units.half_up(F.col("q_nm")).alias("ic50_nm"))


def p1_potency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its potency in micromolar (both ends of a range) and mass in dalton, or open with the reason."""
    q = units.convert_potency(table(spark, sf_dir, "fermfoodb_ace_master_clean").select(*UNIT_COLUMNS))
    ranged = F.col("q_kind") == "range"
    number = F.col("q_kind").isin("single", "bare") | ranged
    by_mass = (F.col("q_dimension") == "mass") | (ranged & (F.col("q_low_dimension") == "mass"))
    status = (
        F.when(F.col("q_nm").isNotNull(), "converted")
        .when(F.col("q_low_nm").isNotNull(), "converted_range")
        .when(ranged & F.startswith("q_unit", F.lit("%")), "percent")
        .when(number & F.col("q_unit").isNull(), "no_unit")
        .when(number & (F.col("q_dimension").isNull() | (ranged & F.col("q_low_dimension").isNull())), "unknown_unit")
        .when(by_mass & F.col("q_mass_da").isNull(), "no_mass")
        .when(number, "not_positive").otherwise(F.col("q_kind"))
    )

    def um(nm: str, name: str):
        return F.round(F.col(nm) / 1000, 6).alias(name)

    return q.select("row_id", um("q_nm", "potency_um"), um("q_low_nm", "potency_um_low"), um("q_high_nm", "potency_um_high"), F.col("q_mass_da").alias("mass_da"), "q_unit_from", status.alias("potency_status"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = recover.line_verdicts(table(spark, sf_dir, "fermfoodb_ace_raw_lines").select("line_id", "raw_line"))
    values = recover.potency_verdicts(table(spark, sf_dir, "fermfoodb_ace_master_clean").select("row_id", "ic50_raw"))
    a = lines.select(F.lit("fermfoodb_ace_raw_lines").alias("ref_table"), F.col("key").alias("row_id"), "reason")
    b = values.select(F.lit("fermfoodb_ace_master_clean").alias("ref_table"), F.col("key").alias("row_id"), "reason")
    return a.unionByName(b)


def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed rows of the export that can be loaded."""
    rows = recover.load_export(table(spark, sf_dir, "fermfoodb_ace_raw_lines").select("line_id", "raw_line"))
    return rows.where(F.col("reason").isNull()).select(F.col("key").alias("line_id"), *recover.EXPORT_FIELDS)


def p2_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected records with reason, fault position and the first invalid field."""
    rows = recover.load_export(table(spark, sf_dir, "fermfoodb_ace_raw_lines").select("line_id", "raw_line"))
    return rows.where(F.col("reason").isNotNull()).select(F.col("key").alias("line_id"), "start", "reason", "at", "column")


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every potency text of the master as loaded, or with reason and place, and whether the stored status says the same."""
    t = table(spark, sf_dir, "fermfoodb_ace_master_clean").select("row_id", "ic50_raw", F.struct("row_id", "ic50_parse_status").alias("k"))
    return _against(recover.potency_readings(t, key="k"), "row_id", "ic50_parse_status")


def p2_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the parse log, against its notes."""
    t = table(spark, sf_dir, "fermfoodb_ace_parse_log").select("log_id", "ic50_raw", F.struct("log_id", "ic50_parse_note").alias("k"))
    return _against(recover.potency_readings(t, key="k"), "log_id", "ic50_parse_note")


def _against(q: DataFrame, key: str, stored: str) -> DataFrame:
    """``stored_agrees``: a stored verdict and the reading both accept or both reject the value; null without a stored one."""
    said = F.lower(clean_text(F.col(f"key.{stored}")))
    rejects = said.contains("unparsed") | said.contains("no_numeric") | said.contains("not_parsed") | said.contains("invalid")
    return q.select(F.col(f"key.{key}").alias(key), "kind", "value", "upper", "unit_text", "reason", "at", F.col(f"key.{stored}").alias(stored), (rejects == F.col("reason").isNotNull()).cast("int").alias("stored_agrees"))


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    lst = table(spark, sf_dir, "fermfoodb_ace_list").select("row_id", "fmdb_id", "crawled_at", "withdrawn_at")
    det = table(spark, sf_dir, "fermfoodb_ace_detail").select("row_id", "fmdb_id", "fetched_at", "withdrawn_at")
    notes = table(spark, sf_dir, "fermfoodb_ace_master_clean").select("row_id", "notes", "standardized_at")

    def refs(df: DataFrame, name: str, target: str, num, at: str) -> DataFrame:
        return df.select(F.lit(name).alias("ref_table"), F.lit(target).alias("target"), "row_id", num.alias("num"), orphans.month(F.col(at)).alias("period"))

    num = orphans.fmdb_number(F.col("fmdb_id"))
    all_refs = (
        refs(lst, "fermfoodb_ace_list", "detail", num, "crawled_at")
        .unionByName(refs(det, "fermfoodb_ace_detail", "list", num, "fetched_at"))
        .unionByName(refs(notes.where(F.col("notes").rlike("(?i)fmdb")), "fermfoodb_ace_master_clean", "list", F.explode(orphans.fmdb_numbers(F.col("notes"))), "standardized_at"))
    )
    targets = {
        "list": orphans.parents(lst, num, F.col("crawled_at"), F.col("withdrawn_at")),
        "detail": orphans.parents(det, num, F.col("fetched_at"), F.col("withdrawn_at")),
    }
    return all_refs, targets


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orphans.orphans(*_references(spark, sf_dir))
    return found.select("ref_table", "row_id", F.col("num").alias("fmdb_no"), "orphan_kind", "period")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.report(orphans.orphans(*_references(spark, sf_dir)))


RESCUED_GROUP = ["rescue_batch", "seq_key"]
RESCUED_NUMERIC = {"mass_mda": 1.0}
RESCUED_TEXTS = ["mass_da_source", "rescue_action"]


def _rescued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and fields of the rescued table; missing values are null, masses are whole millidalton."""
    t = table(spark, sf_dir, "fermfoodb_ace_master_rescued").select("row_id", "rescue_batch", "sequence", "mass_da", *RESCUED_TEXTS)

    def text(c: str):
        v = F.lower(F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")))
        return F.when(~v.isin(MISSING_TOKENS), v)

    seq = F.when(text("sequence").isNotNull(), F.upper(F.regexp_replace("sequence", r"(?U)[\s\-]+", "")))
    mass = F.when(~F.isnan("mass_da") & (F.col("mass_da") > 0), F.floor(F.col("mass_da") * 1000 + 0.5).cast("double"))
    return t.select("row_id", "rescue_batch", seq.alias("seq_key"), mass.alias("mass_mda"), *[text(c).alias(c) for c in RESCUED_TEXTS])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = impute.fill_rows(_rescued(spark, sf_dir), "row_id", RESCUED_GROUP, RESCUED_NUMERIC, RESCUED_TEXTS, how="inner")

    def item(field: str, fill):
        # A case where the posterior is a single value: the group's present values are all the same.
        name = "mass_da" if field == "mass_mda" else field
        return F.when(F.col(f"{field}_fill").isNotNull() & F.col(f"{field}_certain"), F.struct(F.lit(name).alias("field_name"), fill.alias("fill_text")))

    items = [item("mass_mda", F.col("mass_mda_fill").cast("bigint").cast("string")), *[item(c, F.col(f"{c}_fill")) for c in RESCUED_TEXTS]]
    return filled.select("row_id", F.explode(F.array_compact(F.array(*items))).alias("i")).select("row_id", "i.field_name", "i.fill_text")


def p5_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table with filled values and a mask for each field."""
    filled = impute.fill_rows(_rescued(spark, sf_dir), "row_id", RESCUED_GROUP, RESCUED_NUMERIC, RESCUED_TEXTS)
    cols = [F.round(F.coalesce("mass_mda", "mass_mda_fill") / 1000, 3).alias("mass_da"), F.col("mass_mda_fill").isNotNull().cast("int").alias("mass_da_filled")]
    for c in RESCUED_TEXTS:
        cols += [F.coalesce(c, f"{c}_fill").alias(c), F.col(f"{c}_fill").isNotNull().cast("int").alias(f"{c}_filled")]
    return filled.select("row_id", "rescue_batch", *cols)


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_potency, p2_found, p2_loaded, p2_rejected, p2_values, p2_log, p4_found, p4_report, p5_found, p5_filled)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
