"""Classification of grouped potencies: stability, tiers, scores, conflicts. Thresholds are parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaylake.functions.numeric import rounded


@dataclass(frozen=True)
class Thresholds:
    consistent_ratio: float = 10.0
    stable_ratio: float = 3.0
    wide_ratio: float = 30.0
    severe_ratio: float = 100.0
    strong_um: float = 50.0
    medium_um: float = 200.0


DEFAULT = Thresholds()


def stability_flag(sources: Column, records: Column, ratio: Column, t: Thresholds = DEFAULT) -> Column:
    return (
        F.when(records <= 1, "singleton").when(ratio.isNull(), "unknown")
        .when((sources >= 2) & (ratio <= t.consistent_ratio), "cross_source_consistent")
        .when(ratio <= t.consistent_ratio, "within_range_consistent").otherwise("conflicting")
    )


def stability_class(n_unique: Column, low: Column, high: Column, t: Thresholds = DEFAULT) -> Column:
    return (
        F.when(n_unique == 0, "undetermined").when(n_unique == 1, "stable").when(low <= 0, "undetermined")
        .when(high / low <= t.stable_ratio, "stable").when(high / low <= t.consistent_ratio, "condition-sensitive").otherwise("high-conflict")
    )


def activity_tier(median: Column, t: Thresholds = DEFAULT) -> Column:
    return F.when(median <= t.strong_um, "strong").when(median <= t.medium_um, "medium").when(median.isNotNull(), "weak")


def label_grade(valid: Column, length_match: Column, exact: Column, kind: Column, um: Column) -> Column:
    best = (valid == 1) & (length_match == 1) & (exact == 1) & (kind == "exact") & um.isNotNull()
    return F.when(best, "A").when(kind.isin("threshold", "range") | kind.startswith("mass_"), "B").otherwise("C")


def consensus_tier(sources: Column, flag: Column, ratio: Column, median: Column, t: Thresholds = DEFAULT) -> Column:
    agreed = flag.isin("cross_source_consistent", "within_range_consistent") & (ratio <= t.consistent_ratio) & median.isNotNull()
    return (
        F.when((sources >= 3) & agreed, "Tier A").when((sources == 2) & agreed, "Tier B").when((sources == 1) & median.isNotNull(), "Tier C")
        .when((sources >= 2) & (flag == "conflicting"), "Tier D").otherwise("Tier E")
    )


# Points by stability flag.
FLAG_POINTS = {"cross_source_consistent": 25, "within_range_consistent": 18, "singleton": 8, "unknown": 3, "conflicting": -20}


def consensus_score(sources: Column, records: Column, flag: Column, ratio: Column, t: Thresholds = DEFAULT) -> Column:
    by_flag = F.coalesce(*[F.when(flag == k, F.lit(v)) for k, v in FLAG_POINTS.items()], F.lit(0))
    by_ratio = F.when(ratio <= t.stable_ratio, 15).when(ratio <= t.consistent_ratio, 8).when(ratio <= t.wide_ratio, -5).when(ratio.isNotNull(), -12).otherwise(0)
    return (F.least(sources, F.lit(4)) * 20 + F.least(records, F.lit(10)) * 2 + by_flag + by_ratio).cast("int")


def flag_tier(flag: Column) -> Column:
    return F.when(flag == "cross_source_consistent", "Tier_A").when(flag == "within_range_consistent", "Tier_B").when(flag == "singleton", "Tier_C").otherwise("Tier_X")


def flag_rank(tier: Column) -> Column:
    return F.when(tier == "Tier_A", 1).when(tier == "Tier_B", 2).when(tier == "Tier_C", 3).otherwise(9)


def priority(tier: Column, sources: Column, records: Column, ratio: Column) -> Column:
    base = F.when(tier == "Tier_A", 3000.0).when(tier == "Tier_B", 2000.0).when(tier == "Tier_C", 1000.0).otherwise(0.0)
    bonus = F.when(ratio > 0, F.greatest(F.lit(0.0), 100.0 - F.least(ratio, F.lit(100.0)))).otherwise(0.0)
    return F.round(base + sources * 20.0 + records * 5.0 + bonus, 4)


def conflict_reason(flag: Column, sources: Column, records: Column, ratio: Column) -> Column:
    wide = F.coalesce(ratio > 10, F.lit(False))
    return (
        F.when((flag == "conflicting") & (sources >= 2) & wide, "cross_source_large_spread").when((flag == "conflicting") & wide, "large_within_sequence_spread")
        .when(flag == "conflicting", "conflicting_flag_from_merged_input").when((flag == "unknown") & ratio.isNull(), "spread_ratio_missing")
        .when(flag == "unknown", "unknown_flag_from_merged_input").when((records > 1) & wide, "manual_conflict_override_large_spread").otherwise("other_unresolved_case")
    )


def conflict_severity(sources: Column, ratio: Column) -> Column:
    return F.when(ratio.isNull(), "unknown").when((sources >= 2) & (ratio >= 100), "very_high").when(ratio >= 100, "high").when(ratio >= 10, "medium").otherwise("low")


def benchmark_bucket(tier: Column) -> Column:
    """Struct (refined, bucket, priority)."""
    def of(refined, bucket, rank):
        return F.struct(F.lit(refined).alias("refined"), F.lit(bucket).alias("bucket"), F.lit(rank).alias("priority"))

    return (
        F.when(tier == "Tier A", of("Tier_A", "high_confidence_core", 1)).when(tier == "Tier B", of("Tier_B", "high_confidence_core", 2))
        .when(tier == "Tier C", of("Tier_C_single_source", "single_source_candidates", 3)).when(tier == "Tier D", of("Tier_D_conflicting", "conflict_review_pool", 4))
        .otherwise(of("Tier_E_insufficient", "conflict_review_pool", 5))
    )


# Upper bounds of the spread buckets and of the fold bins, with their names.
SPREAD_BUCKETS = [(2.0, "le_2"), (5.0, "gt_2_le_5"), (10.0, "gt_5_le_10"), (100.0, "gt_10_le_100"), (None, "gt_100")]
FOLD_BINS = [(1.0, "1"), (1.5, "(1,1.5]"), (2.0, "(1.5,2]"), (3.0, "(2,3]"), (5.0, "(3,5]"), (10.0, "(5,10]"), (None, ">10")]


def _binned(ratio: Column, bins: list[tuple[float | None, str]]) -> Column:
    out = F.when(ratio.isNull(), "missing")
    for high, name in bins:
        out = out.otherwise(name) if high is None else out.when(ratio <= high, name)
    return out


def spread_bucket(ratio: Column) -> Column:
    return _binned(ratio, SPREAD_BUCKETS)


def fold_bin(ratio: Column) -> Column:
    return _binned(ratio, FOLD_BINS)


def length_consistency(length: Column, declared: Column) -> Column:
    """Five states; a missing length has taken the declared one before, so ``detail_only`` stands for callers that do not."""
    return (
        F.when(length.isNull() & declared.isNull(), "missing_both").when(declared.isNull(), "sequence_only").when(length.isNull(), "detail_only")
        .when(length == declared, "consistent").otherwise("conflict")
    )


# How the notes of the flag tiers and of the benchmark buckets begin.
FLAG_NOTES = {"Tier_A": "跨来源一致", "Tier_B": "单源或局部多源范围内一致", "Tier_C": "单条证据"}
OPEN_NOTE = "存在冲突或状态未明；stability_flag="
BENCHMARK_NOTES = {
    "Tier A": "high-consensus short peptide candidate", "Tier B": "high-consensus short peptide candidate", "Tier C": "single-source usable IC50 candidate",
    "Tier D": "multi-source conflicting short peptide; requires review", "Tier E": "insufficient or unclear evidence pattern",
}


def flag_note(tier: Column, flag: Column, sources: Column, records: Column, ratio: Column) -> Column:
    """What a flag tier rests on, in words; single records have no spread."""
    counts = F.format_string("source_count=%d; record_count=%d", sources, records)
    spread = F.when(ratio.isNotNull() & (tier != "Tier_C"), F.format_string("; spread_ratio=%.4f", rounded(ratio, 4))).otherwise("")
    head = F.coalesce(*[F.when(tier == t, F.lit(f"{n}；")) for t, n in FLAG_NOTES.items()], F.concat(F.lit(OPEN_NOTE), F.coalesce(flag, F.lit("")), F.lit("; ")))
    return F.concat(head, counts, spread)


def benchmark_note(tier: Column, ratio: Column, sources: Column, score: Column) -> Column:
    head = F.coalesce(*[F.when(tier == t, F.lit(n)) for t, n in BENCHMARK_NOTES.items()], F.lit("fallback bucket for unknown tier"))
    spread = F.when(ratio.isNotNull(), F.format_string("%.4f", rounded(ratio, 4))).otherwise("NA")
    return F.concat(head, F.lit("; spread_ratio="), spread, F.format_string("; source_count=%d; score=%d", F.coalesce(sources, F.lit(0)), F.coalesce(score, F.lit(0))))


def stability_note(flag: Column, sources: Column, ratio: Column) -> Column:
    """Why a merged sequence has its stability flag."""
    return (
        F.when(flag == "singleton", "only_one_record_after_merge").when(flag == "unknown", "spread_ratio_unavailable")
        .otherwise(F.concat(F.format_string("source_count=%d; spread_ratio=", sources), F.format_string("%.4f", rounded(ratio, 4))))
    )
