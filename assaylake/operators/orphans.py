"""References to records that do not exist, arrive later or were deleted.

Distinct non-null (key, month) pairs of the references are anti-joined with the parent keys, so rows never
meet rows: both sides are pre-aggregated map-side. A parent key holds one entry per arrival month, so its
array is bounded by the number of months, however often it was crawled. The verdicts go back to the referring
rows by a salted join, since one key may hold a third of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ways in which the rows of one key are spread when the verdicts are joined back.
SALTS = 8


def fmdb_number(text: Column) -> Column:
    """The number of an FMDB id, however written; null if there is none."""
    return F.regexp_extract(text, FMDB, 1).try_cast("bigint")


FMDB = r"(?iU)fmdb[\s_\-​‌‍⁠﻿­]*([0-9]+)"


def fmdb_numbers(text: Column) -> Column:
    """All distinct FMDB numbers that a text mentions."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(FMDB), F.lit(1))
    return F.array_compact(F.array_distinct(F.transform(found, lambda x: x.try_cast("bigint"))))


NEVER = 1 << 30


def month_number(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts)


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def parents(df: DataFrame, ref: Column, arrived: Column, withdrawn: Column) -> DataFrame:
    """(num, first, kept): first arrival month, and per arrival month the last month in which a row still stands.

    Months are whole numbers (year times 12 and month). A row that never was withdrawn stands for ever; one without
    an arrival time is a target that never arrives. Rows without key are no targets.
    """
    months = (
        df.select(ref.alias("num"), F.coalesce(month_number(arrived), F.lit(NEVER)).alias("arr"), F.coalesce(month_number(withdrawn), F.lit(NEVER)).alias("wd"))
        .where(F.col("num").isNotNull())
        .groupBy("num", "arr").agg(F.max("wd").alias("wd"))
    )
    return months.groupBy("num").agg(F.min("arr").alias("first"), F.collect_list(F.struct("arr", "wd")).alias("kept"))


def orphans(refs: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Orphan references: the rows of ``refs`` (ref_table, row_id, target, num, period) with their orphan_kind.

    ``targets`` maps a target name to its :func:`parents`. Rows without number or period refer to nothing.
    Kinds: missing (no such key), late (all arrivals in later months), deleted (all that arrived by the period
    were withdrawn by it).
    """
    refs = refs.where(F.col("num").isNotNull() & F.col("period").isNotNull())
    keys = refs.select("target", "num", "period").distinct()
    held = None
    for name, p in targets.items():
        p = p.withColumn("target", F.lit(name))
        held = p if held is None else held.unionByName(p)
    missing = keys.join(held.select("target", "num"), ["target", "num"], "left_anti").withColumn("orphan_kind", F.lit("missing"))
    by_then = F.filter("kept", lambda k: k["arr"] <= F.col("month"))
    kind = F.when(F.col("first") > F.col("month"), "late").when(~F.exists(by_then, lambda k: k["wd"] > F.col("month")), "deleted")
    then = F.substring("period", 1, 4).cast("int") * 12 + F.substring("period", 6, 2).cast("int")
    stale = keys.withColumn("month", then).join(held, ["target", "num"]).withColumn("orphan_kind", kind).where(F.col("orphan_kind").isNotNull()).select("target", "num", "period", "orphan_kind")
    verdicts = missing.unionByName(stale).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = refs.withColumn("salt", F.pmod(F.xxhash64("ref_table", "row_id"), F.lit(SALTS)).cast("int"))
    return salted.join(verdicts, ["target", "num", "period", "salt"]).select("ref_table", "row_id", "num", "orphan_kind", "period")


def report(found: DataFrame) -> DataFrame:
    """Orphans per table, period and kind; partial counts are combined before the shuffle."""
    return found.groupBy("ref_table", "period", "orphan_kind").agg(
        F.count(F.lit(1)).alias("n_refs"), F.countDistinct("num").alias("n_keys")
    )
