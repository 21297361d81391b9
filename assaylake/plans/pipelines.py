"""The pipelines as composed transforms: records, sequence level, consensus, worksets, analysis tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions import ic50, rules
from assaylake.functions.numeric import geometric_mean, log10_positive, median_of, sig6, spread
from assaylake.functions.plain import once
from assaylake.functions.text import clean_text, is_canonical

SOURCES = {"AHTPDB": "ahtpdb", "BIOPEP": "biopep", "MBPDB": "mbpdb", "FermFooDb": "fermfooddb"}
#: Statuses with which a record of a source enters the merged table.
RESOLVED = ["exact", "threshold", "exact_molar", "molar_threshold"]


def parsed_records(assay: DataFrame) -> DataFrame:
    """Each record with the reading of its own source's parser in ``p``.

    Distinct texts of each source are read, once each, and joined back: texts repeat far more often than they differ.
    """
    texts = assay.select("source_name", "ic50_raw").distinct()
    read = ic50.with_reading(texts, {s: F.col("source_name") == s for s in SOURCES}).withColumnsRenamed({"source_name": "_s", "ic50_raw": "_t"})
    same = (F.col("source_name") == F.col("_s")) & F.col("ic50_raw").eqNullSafe(F.col("_t"))
    return assay.join(read, same).drop("_s", "_t")


def merged_records(assay: DataFrame) -> DataFrame:
    """Records with a sequence and a micromolar value; AHTPDB alone is asked for canonical letters."""
    letters = is_canonical(F.col("sequence")) | ((F.col("source_name") != "AHTPDB") & F.col("sequence").isNotNull())
    p = parsed_records(assay).where(letters & F.col("p.um").isNotNull() & F.col("p.status").isin(RESOLVED))
    return p.select("record_id", "source_name", "sequence", F.length("sequence").alias("peptide_length"), "assay", "method", "model", "species", "year", F.col("p.relation").alias("relation"), F.col("p.status").alias("status"), F.col("p.um").alias("um"))


def sequence_level(records: DataFrame) -> DataFrame:
    """One row per sequence: counts, sets, potency statistics and the stability flag; one shuffle on the sequence."""
    def joined(c: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(clean_text(F.col(c)))), " | ")

    g = records.groupBy("sequence").agg(
        F.first("peptide_length").alias("peptide_length"), F.countDistinct("source_name").alias("source_count"), joined("source_name").alias("source_name_set"),
        F.count(F.lit(1)).alias("record_count_total"), *[F.count_if(F.col("source_name") == s).alias(f"record_count_{n}") for s, n in SOURCES.items()],
        joined("relation").alias("ic50_relation_set"), joined("status").alias("ic50_status_set"), joined("species").alias("species_set"),
        F.min("um").alias("ic50_uM_min"), F.max("um").alias("ic50_uM_max"), F.round(F.avg("um"), 9).alias("ic50_uM_mean"), F.round(F.median("um"), 6).alias("ic50_uM_median"),
        F.min("year").alias("bibliographic_year_min"), F.max("year").alias("bibliographic_year_max"),
    )
    ratio = F.round(spread(F.col("ic50_uM_min"), F.col("ic50_uM_max")), 6)
    g = g.withColumn("ic50_spread_ratio_max_min", ratio).withColumn("cross_source_overlap_flag", (F.col("source_count") >= 2).cast("int"))
    return g.withColumn("stability_flag", rules.stability_flag(F.col("source_count"), F.col("record_count_total"), F.col("ic50_spread_ratio_max_min")))


RATIO = "ic50_spread_ratio_max_min"


def consensus(seq: DataFrame) -> DataFrame:
    n, r, f, x, m = F.col("source_count"), F.col("record_count_total"), F.col("stability_flag"), F.col(RATIO), F.col("ic50_uM_median")
    tier = rules.consensus_tier(n, f, x, m)
    return seq.withColumns(
        {
            "consensus_tier": tier, "consensus_score": rules.consensus_score(n, r, f, x), "high_confidence_flag": tier.isin("Tier A", "Tier B").cast("int"),
            "conflict_flag": (tier == "Tier D").cast("int"), "source_richness_flag": (n >= 3).cast("int"),
        }
    )


def consensus_order() -> list[Column]:
    """Tier, then score from high to low with 0 last, then sequence."""
    score = F.col("consensus_score")
    return [F.col("consensus_tier"), F.when(score == 0, 999999).otherwise(-score), F.col("sequence")]


def flag_consensus(seq: DataFrame) -> DataFrame:
    n, r, x = F.col("source_count"), F.col("record_count_total"), F.col(RATIO)
    tier = rules.flag_tier(F.col("stability_flag"))
    return seq.withColumns(
        {
            "consensus_tier": tier, "consensus_rank": rules.flag_rank(tier), "consensus_keep_flag": tier.isin("Tier_A", "Tier_B").cast("int"), "priority_score": rules.priority(tier, n, r, x),
            "consensus_note": rules.flag_note(tier, F.col("stability_flag"), n, r, x),
        }
    )


def conflicts(seq: DataFrame) -> DataFrame:
    n, r, f, x = F.col("source_count"), F.col("record_count_total"), F.col("stability_flag"), F.col(RATIO)
    return flag_consensus(seq).where("consensus_tier = 'Tier_X'").withColumns({"conflict_reason": rules.conflict_reason(f, n, r, x), "conflict_severity": rules.conflict_severity(n, x)})


def benchmark(cons: DataFrame) -> DataFrame:
    return cons.withColumn("b", rules.benchmark_bucket(F.col("consensus_tier"))).select(
        "sequence", "consensus_tier", "consensus_score", "source_count", RATIO, F.col("b.refined").alias("refined_tier"), F.col("b.bucket").alias("benchmark_bucket"), F.col("b.priority").alias("benchmark_priority"),
        rules.benchmark_note(F.col("consensus_tier"), F.col(RATIO), F.col("source_count"), F.col("consensus_score")).alias("benchmark_note"),
    )


def highconf(records: DataFrame) -> DataFrame:
    """Sequence aggregate over distinct values of exact short records, with stability class and activity tier.

    Shown values have six significant digits, and the tier is that of the shown median; class and fold come from
    the values themselves. Lists are sorted.
    """
    exact = records.where(F.col("status").isin("exact", "exact_molar") & F.col("peptide_length").isin(2, 3) & is_canonical(F.col("sequence")))
    named = {"source": "source_name", "assay": "assay", "method": "method", "model": "model"}
    g = exact.groupBy("sequence").agg(
        F.count(F.lit(1)).alias("record_count"), F.array_sort(F.collect_set("um")).alias("v"),
        *[F.array_sort(F.collect_set(clean_text(F.col(c)))).alias(n) for n, c in {**named, "record_id": "record_id"}.items()],
    )
    v, low, high = F.col("v"), F.array_min("v"), F.array_max("v")
    g = g.select(
        "sequence", F.length("sequence").alias("peptide_length"), "record_count", F.size(v).alias("n_unique"), sig6(low).alias("um_min"), sig6(high).alias("um_max"), once(median_of(v)).alias("m"),
        sig6(geometric_mean(v)).alias("um_geomean"), rules.stability_class(F.size(v), low, high).alias("stability_class"), F.when(F.size(v) == 1, 1.0).otherwise(spread(low, high)).alias("x"),
        *[F.size(n).alias(f"{n}_count") for n in named], *[F.array_join(n, " | ").alias(f"{n}_list") for n in (*named, "record_id")],
    )
    return g.withColumns({"um_median": sig6(F.col("m")), "log10_median": sig6(log10_positive(F.col("m"))), "fold": sig6(F.col("x"))}).withColumn("activity_tier", rules.activity_tier(F.col("um_median"))).drop("m", "x")


def stable(records: DataFrame) -> DataFrame:
    """The stable sequences of :func:`highconf`."""
    return highconf(records).where("stability_class = 'stable'")


# Ranks of the orders of the consensus, conflict and short-peptide tables.
SEVERITY_RANK = {"very_high": 1, "high": 2, "medium": 3, "low": 4, "unknown": 5}
CLASS_RANK = {"stable": 0, "condition-sensitive": 1, "high-conflict": 2, "undetermined": 3}
TIER_RANK = {"strong": 0, "medium": 1, "weak": 2}


def _rank(c: str, ranks: dict[str, int]) -> Column:
    return F.coalesce(*[F.when(F.col(c) == k, F.lit(r)) for k, r in ranks.items()], F.lit(99))


def flag_order() -> list[Column]:
    """Rank, priority from high to low, length (missing and 0 as 999), sequence."""
    n = F.col("peptide_length")
    return [F.col("consensus_rank"), -F.col("priority_score"), F.when(n.isNull() | (n == 0), 999).otherwise(n), F.col("sequence")]


def conflict_order() -> list[Column]:
    """Severity, ratio from high to low (missing and 0 behind, as 1), sequence."""
    x = F.col(RATIO)
    return [_rank("conflict_severity", SEVERITY_RANK), F.when(x.isNull() | (x == 0), 1.0).otherwise(-x), F.col("sequence")]


def short_order(by: str) -> list[Column]:
    """Dipeptides first, then by stability class or activity tier, median (missing last), sequence."""
    return [F.when(F.col("peptide_length") == 2, 0).otherwise(1), _rank(by, CLASS_RANK if by == "stability_class" else TIER_RANK), F.coalesce("um_median", F.lit(float("inf"))), F.col("sequence")]
