"""Sequence features: composition, moments, autocorrelation and spectrum of property signals.

Everything is a higher-order function over the residues; the spectrum is the closed-form discrete Fourier
transform, fit for peptides of tens of residues. Sequences must be canonical; the empty one gives zeros.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.plain import once
from assaylake.functions.text import AMINO_ACIDS

# Residue property scales.
HYDRO = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3}
CHARGE = {"A": 0.0, "C": 0.0, "D": -1.0, "E": -1.0, "F": 0.0, "G": 0.0, "H": 0.1, "I": 0.0, "K": 1.0, "L": 0.0, "M": 0.0, "N": 0.0, "P": 0.0, "Q": 0.0, "R": 1.0, "S": 0.0, "T": 0.0, "V": 0.0, "W": 0.0, "Y": 0.0}
POLARITY = {"A": 8.1, "C": 5.5, "D": 13.0, "E": 12.3, "F": 5.2, "G": 9.0, "H": 10.4, "I": 5.2, "K": 11.3, "L": 4.9, "M": 5.7, "N": 11.6, "P": 8.0, "Q": 10.5, "R": 10.5, "S": 9.2, "T": 8.6, "V": 5.9, "W": 5.4, "Y": 6.2}
WEIGHT = {"A": 89.09, "C": 121.15, "D": 133.10, "E": 147.13, "F": 165.19, "G": 75.07, "H": 155.16, "I": 131.17, "K": 146.19, "L": 131.17, "M": 149.21, "N": 132.12, "P": 115.13, "Q": 146.15, "R": 174.20, "S": 105.09, "T": 119.12, "V": 117.15, "W": 204.23, "Y": 181.19}
SCALES = {"hydro": HYDRO, "charge": CHARGE, "polarity": POLARITY, "mw": WEIGHT}


def composition(seq: Column) -> Column:
    """Twenty fractions in alphabet order, then the length."""
    n = F.length(seq)
    letters = F.array(*[F.lit(a) for a in AMINO_ACIDS])
    parts = F.transform(letters, lambda a: F.when(n > 0, (n - F.length(F.replace(seq, a, F.lit("")))) / n).otherwise(0.0))
    return F.concat(parts, F.array(n.cast("double")))


def signal(seq: Column, scale: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in scale.items() for x in kv])
    return F.transform(F.filter(F.split(seq, ""), lambda r: r != ""), lambda r: table[r])


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _mean(x: Column) -> Column:
    return _sum(x) / F.greatest(F.size(x), F.lit(1))


def _centred(x: Column) -> Column:
    return F.transform(x, lambda v: v - _mean(x))


def autocorrelation(x: Column, lag: int) -> Column:
    """Pearson correlation of the signal with itself shifted; 0 where a side does not vary."""
    n = F.size(x) - lag
    a, b = F.slice(x, 1, F.greatest(n, F.lit(0))), F.slice(x, lag + 1, F.greatest(n, F.lit(0)))
    ca, cb = _centred(a), _centred(b)
    va, vb = _sum(F.transform(ca, lambda v: v * v)), _sum(F.transform(cb, lambda v: v * v))
    cov = _sum(F.zip_with(ca, cb, lambda p, q: p * q))
    flat = (n <= 0) | (va / F.greatest(n, F.lit(1)) < 1e-24) | (vb / F.greatest(n, F.lit(1)) < 1e-24)
    return F.when(flat, 0.0).otherwise(cov / F.sqrt(va * vb))


def magnitudes(x: Column) -> Column:
    """Magnitudes of the one-sided spectrum."""
    n = F.size(x)

    def bin_of(k: Column) -> Column:
        re = F.aggregate(F.transform(x, lambda v, i: v * F.cos(2 * math.pi * k * i / n)), F.lit(0.0), lambda a, v: a + v)
        im = F.aggregate(F.transform(x, lambda v, i: v * F.sin(2 * math.pi * k * i / n)), F.lit(0.0), lambda a, v: a + v)
        return F.sqrt(re * re + im * im)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int")), bin_of)).otherwise(F.array().cast("array<double>"))


def moments(x: Column) -> Column:
    """mean, population deviation, least, greatest, energy."""
    mean = _mean(x)
    energy = _mean(F.transform(x, lambda v: v * v))
    none = F.size(x) == 0
    return F.array(
        F.when(none, 0.0).otherwise(mean), F.when(none, 0.0).otherwise(F.sqrt(_mean(F.transform(_centred(x), lambda v: v * v)))),
        F.coalesce(F.array_min(x), F.lit(0.0)), F.coalesce(F.array_max(x), F.lit(0.0)), F.when(none, 0.0).otherwise(energy),
    )


def spectrum(mag: Column) -> Column:
    """Spectral energy, centroid, and the dominant bin relative to the last, from the magnitudes."""
    total = _sum(mag)
    weighted = _sum(F.transform(mag, lambda v, i: v * i))
    top = F.array_position(mag, F.array_max(mag)) - 1
    return F.array(
        _sum(F.transform(mag, lambda v: v * v)), F.when(total < 1e-12, 0.0).otherwise(weighted / total),
        F.coalesce(F.when(F.size(mag) > 0, top / F.greatest(F.size(mag) - 1, F.lit(1))), F.lit(0.0)).cast("double"),
    )


def with_signal_features(df: DataFrame, seq: str, name: str = "features") -> DataFrame:
    """Composition (21), ten features for each of the four scales, and the length: 62 numbers in ``name``.

    Signals and spectra are stages behind generators of one row, so each is computed once.
    """
    kept = [*df.columns]
    s = F.col(seq)
    rows = df.select(*kept, once(F.struct(*[signal(s, t).alias(k) for k, t in SCALES.items()])).alias("_x"))
    rows = rows.select(*kept, "_x", once(F.struct(*[magnitudes(F.col(f"_x.{k}")).alias(k) for k in SCALES])).alias("_m"))
    parts = []
    for k in SCALES:
        x = F.col(f"_x.{k}")
        parts += [moments(x), F.array(autocorrelation(x, 1), autocorrelation(x, 2)), spectrum(F.col(f"_m.{k}"))]
    return rows.select(*kept, F.concat(composition(s), *parts, F.array(F.length(s).cast("double"))).alias(name))
