"""Missing numbers and categories filled from similar records, by EM on mixed mixtures.

Within a group the records follow a mixture of two components; each holds a Gaussian per numeric field and a
multinomial per categorical field. Rows are first reduced to distinct value patterns with a weight, combined
map-side. Groups whose missing fields have one present value each are at the fixed point with the first statistics
and take no part in the rounds; the others run M and E steps until none of their responsibilities moves:
groups of up to ``GROUP_PATTERNS`` patterns as arrays, many groups at once, larger ones as distributed sums of
sufficient statistics, which go back to the patterns over salts. Both ways take the same steps. From the last
responsibilities one more distributed M step gives the posteriors: missing numbers get the conditional expectation
over the components, missing categories the mode of the likelier component; each fill says whether its posterior is
a single value (no variance, no mass on another category). Fills go back to the rows by a salted join.

Defined results: rows without group, and fields of which the group holds no value, stay open; a group of one
value gets exactly that value; ties between modes go to the greatest text. Empty tables give empty tables. A group
that still moves after ``MAX_ROUNDS`` keeps its last state and is reported by ``em_settled`` = false.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.session import Rounds, cut_lineage

SALTS = 8
#: Responsibilities that move less than this have settled; rounds after which the rest is reported as it is.
TOLERANCE, MAX_ROUNDS = 1e-3, 200
#: Patterns of a group up to which it is fitted as one row of arrays (about 3 MB).
GROUP_PATTERNS = 50_000
#: Least variance of a Gaussian, as a share of the numeric resolution squared.
LEAST_VARIANCE = 0.25
PRIOR = 0.5


def _any(parts: list[Column]) -> Column:
    """One of them is true; an array, since the optimiser takes long disjunctions apart at great length."""
    return F.array_contains(F.array(*parts), True)


def _patterns(df: DataFrame, group: list[str], numeric: list[str], categorical: list[str]) -> DataFrame:
    """Distinct (group, values) with their weight ``w``."""
    present = reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in group])
    return df.where(present).groupBy(*group, *numeric, *categorical).agg(F.count(F.lit(1)).cast("double").alias("w"))


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def _first_statistics(p: DataFrame, group: list[str], fields: list[str], nums: list[str]) -> DataFrame:
    """Per group and field the least value, whether there are several (``_many``), and whether some are missing."""
    out = []
    for c in fields:
        # Texts are compared by hash here: grouped numbers need no sort.
        v = F.col(c) if c in nums else F.xxhash64(c)
        v = F.when(F.col(c).isNotNull(), v)
        out += [F.min(v).alias(f"{c}_low"), F.max(v).alias(f"{c}_high"), F.max(F.col(c).isNull()).alias(f"{c}_open")]
    g = p.groupBy(*group).agg(*out, F.count(F.lit(1)).alias("n_patterns"))
    for c in fields:
        g = g.withColumn(f"{c}_many", F.coalesce(F.col(f"{c}_high") > F.col(f"{c}_low"), F.lit(False)))
    return g.withColumn("active", _any([F.col(f"{c}_many") & F.col(f"{c}_open") for c in fields]))


def _start(nums: list[str], cats: list[str]) -> Column:
    """First share of component 1: by the place between the group's extremes, else by a hash of the categories."""
    out = F.when(F.pmod(F.xxhash64(*cats), F.lit(2)) == 0, 0.4).otherwise(0.6)
    for c in reversed(nums):
        low, high = F.col(f"{c}_low"), F.col(f"{c}_high")
        out = F.when(F.col(c).isNotNull() & (high > low), 0.1 + 0.8 * (F.col(c) - low) / (high - low)).otherwise(out)
    return out


class _Mixture:
    """Sufficient statistics and posteriors of the groups of ``p``; numbers are centred at the group's least value."""

    def __init__(self, group: list[str], numeric: dict[str, float], cats: list[str]):
        self.group, self.numeric, self.cats = group, numeric, cats

    def sums(self, p: DataFrame) -> DataFrame:
        """M step: one row per group."""
        out = [F.max("moved").alias("group_moved")]
        for k in (0, 1):
            share = F.col("w") * (F.col("r1") if k else 1 - F.col("r1"))
            out.append(F.sum(share).alias(f"n{k}"))
            for c in self.numeric:
                x = F.col(c) - F.col(f"{c}_low")
                out += [F.sum(F.when(x.isNotNull(), share)).alias(f"{c}_n{k}"), F.sum(share * x).alias(f"{c}_s{k}"), F.sum(share * x * x).alias(f"{c}_q{k}")]
            out += [F.sum(F.when(F.col(c).isNotNull(), share)).alias(f"{c}_d{k}") for c in self.cats]
        return p.groupBy(*self.group).agg(*out)

    def masses(self, p: DataFrame, c: str) -> DataFrame:
        """M step of a category: mass per group and category in both components."""
        share = [F.sum(F.col("w") * (F.col("r1") if k else 1 - F.col("r1"))).alias(f"{c}_c{k}") for k in (0, 1)]
        return p.where(F.col(c).isNotNull()).groupBy(*self.group, c).agg(*share)

    def mean(self, c: str, k: int) -> Column:
        return F.try_divide(F.col(f"{c}_s{k}"), F.col(f"{c}_n{k}"))

    def second(self, c: str, k: int) -> Column:
        return F.try_divide(F.col(f"{c}_q{k}"), F.col(f"{c}_n{k}"))

    def log_likelihood(self, k: int) -> Column:
        out = F.log(F.col(f"n{k}") + F.lit(1e-9))
        for c, step in self.numeric.items():
            var = F.greatest(self.second(c, k) - self.mean(c, k) * self.mean(c, k), F.lit(LEAST_VARIANCE * step * step))
            d = F.col(c) - F.col(f"{c}_low") - self.mean(c, k)
            out = out + F.coalesce(-0.5 * F.log(var) - F.try_divide(d * d, 2 * var), F.lit(0.0))
        for c in self.cats:
            out = out + F.coalesce(F.log(F.try_divide(F.col(f"{c}_c{k}") + PRIOR, F.col(f"{c}_d{k}") + 2 * PRIOR)), F.lit(0.0))
        return out

    def with_sums(self, p: DataFrame) -> DataFrame:
        """The patterns with the statistics of their group, which are spread over the salts."""
        return p.join(_salted(self.sums(p)), [*self.group, "_salt"])

    def round(self, p: DataFrame) -> DataFrame:
        """One M and E step; ``moved`` is how far a responsibility went."""
        j = self.with_sums(p)
        for c in self.cats:
            j = j.join(self.masses(p, c), [*self.group, c], "left")
        gap = F.least(F.greatest(self.log_likelihood(0) - self.log_likelihood(1), F.lit(-50.0)), F.lit(50.0))
        new = F.when(F.col("group_moved") < TOLERANCE, F.col("r1")).otherwise(1 / (1 + F.exp(gap)))
        return j.withColumn("r", new).select(*[c for c in p.columns if c not in ("r1", "moved")], F.col("r").alias("r1"), F.abs(F.col("r") - F.col("r1")).alias("moved"))

    def rounds_of_large(self, p: DataFrame, rounds: int) -> DataFrame:
        """The patterns with settled responsibilities, by distributed rounds."""
        kept = Rounds(p.sparkSession)
        for _ in range(rounds):
            p = kept.keep(self.round(p))
            if (p.agg(F.max("moved")).first()[0] or 0.0) < TOLERANCE:
                break
        return p

    def rounds_of_small(self, p: DataFrame, rounds: int) -> DataFrame:
        """The same for groups that are one row of arrays each; the arrays of a batch of groups are worked on together."""
        nums, cats = list(self.numeric), self.cats
        floors = [LEAST_VARIANCE * step * step for step in self.numeric.values()]
        coded = [(F.col(c) - F.col(f"{c}_low")).alias(c) for c in nums] + [F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(c) for c in cats]
        rest = [c for c in p.columns if c not in (*self.group, "r1", "moved")]
        rows = p.groupBy(*self.group).agg(F.collect_list(F.struct("w", "r1", *coded, F.struct(*rest).alias("row"))).alias("x"))
        rows = rows.select(*self.group, *[F.col(f"x.{c}").alias(c) for c in ("w", "r1", *nums, *cats, "row")])
        given = [*nums, *cats]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                col = {n: b.column(b.schema.get_field_index(n)) for n in ("w", "r1", *given)}
                r1, moved = _settle(col["w"], col["r1"], [col[c] for c in nums], [col[c] for c in cats], floors, rounds)
                offsets = col["w"].offsets
                arrays = [pa.ListArray.from_arrays(pa.array(np.asarray(offsets) - offsets[0].as_py(), pa.int32()), pa.array(v)) for v in (r1, moved)]
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(n)) for n in (*self.group, "row")], *arrays], names=[*self.group, "row", "r1", "moved"])

        kinds = dict(rows.dtypes)
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*self.group, "row")) + ", r1 array<double>, moved array<double>"
        fitted = rows.mapInArrow(run, schema)
        back = fitted.select(*self.group, F.explode(F.arrays_zip("row", "r1", "moved")).alias("e"))
        return back.select(*self.group, "e.row.*", "e.r1", "e.moved").select(*p.columns)

    def fills(self, p: DataFrame) -> DataFrame:
        """Per pattern and field ``<f>_fill`` and ``<f>_certain``, from the posterior."""
        j = self.with_sums(p).withColumn("em_settled", F.col("group_moved") < TOLERANCE)
        for c in self.cats:
            modes = [F.max(F.struct(f"{c}_c{k}", c)).alias(f"{c}_m{k}") for k in (0, 1)]
            j = j.join(_salted(self.masses(p, c).groupBy(*self.group).agg(*modes, F.count(F.lit(1)).alias(f"{c}_kinds"))), [*self.group, "_salt"], "left")
        out: dict[str, Column] = {}
        share = [1 - F.col("r1"), F.col("r1")]
        for c, step in self.numeric.items():
            def over(part) -> Column:
                return F.coalesce(share[0] * part(c, 0) + share[1] * part(c, 1), part(c, 1), part(c, 0))  # noqa: B023

            mean = over(self.mean)
            out[f"{c}_fill"] = F.when(F.col(c).isNull(), F.floor((F.col(f"{c}_low") + mean) / step + 0.5) * step)
            out[f"{c}_certain"] = (over(self.second) - mean * mean == 0) & (mean == 0)
        for c in self.cats:
            likelier = F.when(F.col("r1") >= 0.5, F.col(f"{c}_m1.{c}")).otherwise(F.col(f"{c}_m0.{c}"))
            out[f"{c}_fill"] = F.when(F.col(c).isNull(), likelier)
            out[f"{c}_certain"] = F.col(f"{c}_kinds") == 1  # every category of the group has mass above 0 in both components
        return j.select(*self.group, *self.numeric, *self.cats, *[v.alias(n) for n, v in out.items()], "em_settled")


def _settle(w: pa.Array, r1: pa.Array, numbers: list[pa.Array], categories: list[pa.Array], floors: list[float], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(responsibilities, last movement) of the patterns of a batch of groups, one list of patterns per group."""
    sizes = np.diff(np.asarray(w.offsets))
    group = np.repeat(np.arange(len(sizes)), sizes)
    weight, r = (np.array(x.flatten(), float) for x in (w, r1))
    values = [np.array(x.flatten().to_numpy(zero_copy_only=False), float) for x in numbers]  # null is NaN
    seen = [~np.isnan(v) for v in values]
    values = [np.nan_to_num(v) for v in values]
    known, cells, of_cell = [], [], []
    for x in categories:
        flat = x.flatten()
        known.append(np.asarray(flat.is_valid()))
        pairs = np.stack([group, np.asarray(flat.fill_null(0), np.int64)], axis=1)
        _, cell = np.unique(pairs, axis=0, return_inverse=True)
        cells.append(cell.ravel())
        of_cell.append(int(cell.max()) + 1 if len(cell) else 0)
    n = len(sizes)
    moved = np.ones(len(r))
    if not len(r):
        return r, moved
    total = lambda x: np.bincount(group, x, n)
    for _ in range(rounds):
        ll = []
        for share in (weight * (1 - r), weight * r):
            out = np.log(total(share) + 1e-9)[group]
            for v, s, floor in zip(values, seen, floors):
                held = total(share * s)
                with np.errstate(invalid="ignore", divide="ignore"):
                    mean, second = total(share * v) / held, total(share * v * v) / held
                    var = np.maximum(second - mean * mean, floor)
                    term = -0.5 * np.log(var[group]) - (v - mean[group]) ** 2 / (2 * var[group])
                out = out + np.where(s & (held[group] > 0), np.nan_to_num(term), 0.0)
            for k, cell, m in zip(known, cells, of_cell):
                mass, held = np.bincount(cell, share * k, m), total(share * k)
                out = out + np.where(k, np.log((mass[cell] + PRIOR) / (held[group] + 2 * PRIOR)), 0.0)
            ll.append(out)
        new = 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -50, 50)))
        last = np.zeros(n)
        np.maximum.at(last, group, moved)
        new = np.where(last[group] < TOLERANCE, r, new)
        moved, r = np.abs(new - r), new
        if moved.max() < TOLERANCE:
            break
    return r, moved


def em_fill(df: DataFrame, group: list[str], numeric: dict[str, float], categorical: list[str], rounds: int = MAX_ROUNDS) -> DataFrame:
    """Patterns with a missing field and their fills: group, fields, per field ``<f>_fill`` and ``<f>_certain``, em_settled.

    ``numeric`` maps a field to its resolution. Missing values must be null.
    """
    nums, cats = list(numeric), list(categorical)
    fields = [*nums, *cats]
    p = _patterns(df, group, nums, cats)
    first = _first_statistics(p, group, fields, nums)
    p = p.withColumn("_salt", _salt(*fields)).join(_salted(first), [*group, "_salt"])
    p = cut_lineage(p.where(_any([F.col("active"), *[F.col(c).isNull() for c in fields]])))

    # Single-valued fields: the posterior of the first statistics. Their text comes from the rows that have it.
    settled = p.where(~F.col("active"))
    out = {}
    for c in fields:
        out[f"{c}_certain"] = F.col(f"{c}_low").isNotNull()
        if c in nums:
            out[f"{c}_fill"] = F.when(F.col(c).isNull(), F.floor(F.col(f"{c}_low") / numeric[c] + 0.5) * numeric[c])
    for c in cats:
        known = df.where(F.col(c).isNotNull() & F.col(group[0]).isNotNull()).select(F.xxhash64(c).alias(f"{c}_low"), F.col(c).alias("_text")).distinct()
        settled = settled.join(known, f"{c}_low", "left").withColumn(f"{c}_fill", F.when(F.col(c).isNull(), F.col("_text"))).drop("_text")
    names = [*group, *fields, *[f"{c}_{x}" for c in fields for x in ("fill", "certain")], "em_settled"]
    settled = settled.withColumns(out | {"em_settled": F.lit(True)}).select(*names)

    mix = _Mixture(group, numeric, cats)
    moving = p.where("active").withColumn("r1", _start(nums, cats)).withColumn("moved", F.lit(1.0))
    large = F.col("n_patterns") > GROUP_PATTERNS
    fitted = mix.rounds_of_small(moving.where(~large), rounds)
    if not moving.where(large).isEmpty():
        fitted = fitted.unionByName(mix.rounds_of_large(moving.where(large), rounds))
    fitted = cut_lineage(fitted)  # read by the statistics and by the posteriors
    return settled.unionByName(mix.fills(fitted).where(_any([F.col(c).isNull() for c in fields])).select(*names))


def fill_rows(rows: DataFrame, key: str, group: list[str], numeric: dict[str, float], categorical: list[str], how: str = "left") -> DataFrame:
    """The rows with ``<f>_fill`` and ``<f>_certain`` of their pattern; ``how="inner"`` keeps rows with a fill only.

    Only patterns in which a field is missing take part in the join, each once per salt.
    """
    fields = [*numeric, *categorical]
    fills = em_fill(rows.select(key, *group, *fields), group, numeric, categorical)
    fills = fills.where(_any([F.col(f"{f}_fill").isNotNull() for f in fields]))
    # The two sides come from one table; renamed keys keep the null-safe join unambiguous.
    fills = _salted(fills.withColumnsRenamed({c: f"_{c}" for c in (*group, *fields)}))
    rows = rows.withColumn("_row_salt", _salt(key))
    on = [rows[g] == fills[f"_{g}"] for g in group] + [rows[f].eqNullSafe(fills[f"_{f}"]) for f in fields] + [rows["_row_salt"] == fills["_salt"]]
    return rows.join(fills, reduce(lambda a, b: a & b, on), how).drop("_row_salt", "_salt", *[f"_{c}" for c in (*group, *fields)])
