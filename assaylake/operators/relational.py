"""Relational kit: deterministic dedupes, profiles, summaries, enrichment and reverse pairs.

All transforms are lazy DataFrame -> DataFrame. Duplicate policies are aggregates over an ordering column
(``min_by``/``max_by`` keep one row per key map-side), so a hot key never gathers its rows in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions.text import AMINO_ACIDS, is_missing
from assaylake.session import cut_lineage


def _row(df: DataFrame, key: str) -> Column:
    return F.struct(*[c for c in df.columns if c != key])


def _one_per_key(df: DataFrame, key: str, order: Column, latest: bool, keep_null: bool = False) -> DataFrame:
    pick = F.max_by if latest else F.min_by
    return (df if keep_null else df.where(F.col(key).isNotNull())).groupBy(key).agg(pick(_row(df, key), order).alias("_r"), F.count(F.lit(1)).alias("dup_count")).select(key, "_r.*", "dup_count")


def keep_first(df: DataFrame, key: str, order: Column, keep_null: bool = False) -> DataFrame:
    """The first row of each key by ``order``, with the number of rows; rows without key go, or one of them stays."""
    return _one_per_key(df, key, order, latest=False, keep_null=keep_null)


def keep_last(df: DataFrame, key: str, order: Column) -> DataFrame:
    return _one_per_key(df, key, order, latest=True)


def richness(cols: list[str]) -> Column:
    """Number of fields that are not missing."""
    return reduce(lambda a, b: a + b, [(~is_missing(F.col(c))).cast("int") for c in cols])


def keep_richest(df: DataFrame, key: str, order: Column, fields: list[str]) -> DataFrame:
    """The row with most present fields; the first of equals."""
    return _one_per_key(df, key, F.struct(-richness(fields), order), latest=False)


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, total, missing, present, missing_ratio) of every column, in one pass."""
    cols = cols or df.columns
    one = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(is_missing(F.col(c).cast("string"))).alias(f"_{i}") for i, c in enumerate(cols)])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("missing")) for i, c in enumerate(cols)])
    ratio = F.round(F.try_divide(F.col("missing"), F.col("total")), 6)
    return one.select("total", F.explode(items).alias("i")).select("i.column", "total", "i.missing", (F.col("total") - F.col("i.missing")).alias("present")).withColumn("missing_ratio", F.coalesce(ratio, F.lit(0.0)))


def share_of_total(counts: DataFrame, n: str = "n") -> DataFrame:
    """Adds the percentage of the whole; the counts are a small grouped table."""
    return counts.withColumn("pct", F.round(100 * F.col(n) / F.sum(n).over(Window.partitionBy()), 2))


def metric_summary(df: DataFrame, dims: list[str]) -> DataFrame:
    """(metric, value): the total, and ``dim::value`` counts, from one pass over grouping sets."""
    df = df.select(*[F.coalesce(F.col(d).cast("string"), F.lit("NA")).alias(d) for d in dims])
    sets = [[], *[[F.col(d)] for d in dims]]
    g = df.groupingSets(sets, *dims).agg(F.count(F.lit(1)).alias("value"), *[F.grouping(d).alias(f"g_{d}") for d in dims])
    name = F.coalesce(*[F.when(F.col(f"g_{d}") == 0, F.concat(F.lit(f"{d}::"), F.col(d))) for d in dims], F.lit("total"))
    return g.select(name.alias("metric"), "value")


def multiplicity_histogram(df: DataFrame, key: str) -> DataFrame:
    """(multiplicity, n_keys, n_rows): how many keys occur how often."""
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("multiplicity"))
    return per.groupBy("multiplicity").agg(F.count(F.lit(1)).alias("n_keys")).withColumn("n_rows", F.col("multiplicity") * F.col("n_keys"))


def zero_filled(counts: DataFrame, domain: dict[str, list], value: str) -> DataFrame:
    """All combinations of the fixed domain values, with 0 where nothing was counted."""
    spark = counts.sparkSession
    d = spark.range(1)
    for c, vals in domain.items():
        d = d.withColumn(c, F.explode(F.array(*[F.lit(v) for v in vals])))
    return d.drop("id").join(counts, list(domain), "left").fillna(0, [value])


def residues(df: DataFrame, seq: str, keep: list[str]) -> DataFrame:
    """One row per residue with its position from 1."""
    return df.select(*keep, F.posexplode(F.split(seq, "")).alias("p", "residue")).where("residue <> ''").withColumn("position", F.col("p") + 1).drop("p")


def residue_shares(df: DataFrame, seq: str, groups: dict[str, list]) -> DataFrame:
    """Counts and shares of all twenty residues within every combination of ``groups`` (column -> fixed values), zeros included.

    ``seq`` holds one residue a row; shares are 0 where a group is empty.
    """
    on = list(groups)
    n = df.groupBy(*on, F.col(seq).alias("residue")).agg(F.count(F.lit(1)).alias("n"))
    t = zero_filled(n, groups | {"residue": list(AMINO_ACIDS)}, "n")
    share = F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(*on)))
    return t.withColumn("share", F.round(F.coalesce(share, F.lit(0.0)), 6))


def enrichment(df: DataFrame, residue: str, strong: Column, groups: dict[str, list]) -> DataFrame:
    """Counts and shares of all twenty residues among strong and all rows of every group, and log2 fold change with half a pseudocount."""
    on = list(groups)
    n = df.groupBy(*on, F.col(residue).alias("residue")).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(strong).alias("n_strong"))
    t = zero_filled(n, groups | {"residue": list(AMINO_ACIDS)}, "n_all").fillna(0, ["n_strong"])
    w = Window.partitionBy(*on)
    all_total, strong_total = F.sum("n_all").over(w), F.sum("n_strong").over(w)
    fa, fs = F.coalesce(F.try_divide(F.col("n_all"), all_total), F.lit(0.0)), F.coalesce(F.try_divide(F.col("n_strong"), strong_total), F.lit(0.0))
    fold = ((F.col("n_strong") + 0.5) / (strong_total + 10.0)) / ((F.col("n_all") + 0.5) / (all_total + 10.0))
    return t.withColumns({"freq_all": F.round(fa, 6), "freq_strong": F.round(fs, 6), "diff": F.round(fs - fa, 6), "log2fc": F.round(F.log2(fold), 6)})


def reverse_pairs(df: DataFrame, seq: str, values: list[str]) -> DataFrame:
    """Unordered pairs of a sequence and its reverse, each once, with the values of both (``<v>_a``, ``<v>_b``)."""
    a = df.select(F.col(seq).alias("seq_a"), *[F.col(v).alias(f"{v}_a") for v in values], F.reverse(seq).alias("seq_b")).where("seq_a < seq_b")
    return a.join(df.select(F.col(seq).alias("seq_b"), *[F.col(v).alias(f"{v}_b") for v in values]), "seq_b")


def numbered(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """Sequential numbers from 1 in a total order, without one task for all rows.

    Rows are range-partitioned and sorted; each partition then numbers its own rows behind the number of rows
    before it. The offsets are one number per partition.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = ordered.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    ordered = cut_lineage(ordered)  # range boundaries are sampled; both readers below must see the same ones
    counts = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"), F.min("_m").alias("_first"))
    offsets = counts.select("_p", "_first", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_before"))
    return ordered.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_before") + F.col("_m") - F.col("_first") + 1).drop("_p", "_m", "_first", "_before")


def append_unique(old: DataFrame, new: DataFrame, key: str, id_col: str, prefix: str) -> DataFrame:
    """Rows of ``new`` whose key is unknown, with the next free ``prefix_%03d`` numbers in key order."""
    last = old.agg(F.coalesce(F.max(F.regexp_extract(F.col(id_col), r"(\d+)$", 1).try_cast("bigint")), F.lit(0)).alias("last"))
    fresh = new.join(old.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.min(_row(new, key)).alias("_r")).select(key, "_r.*")
    fresh = numbered(fresh, [F.col(key)], "_n").withColumn("_last", last.scalar())
    return fresh.withColumn(id_col, F.format_string(f"{prefix}_%03d", F.col("_last") + F.col("_n"))).drop("_n", "_last")
