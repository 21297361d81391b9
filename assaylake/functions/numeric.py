"""Numbers out of text, unit factors, masses and small statistics over arrays. Null in, null out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plain decimal notation; other notations that engines differ in are rejected.
FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Factors to micromolar, and of mass concentrations with a mass in dalton.
MOLAR_TO_UM = {"pM": 1e-6, "nM": 1e-3, "uM": 1.0, "mM": 1e3, "M": 1e6}
MASS_TO_UM = {"ng/ml": 1.0, "ug/ml": 1e3, "mg/ml": 1e6}
# Monoisotopic residue masses in dalton, and water.
WATER = 18.01056
RESIDUE_MASS = {
    "A": 71.03711, "C": 103.00919, "D": 115.02694, "E": 129.04259, "F": 147.06841, "G": 57.02146, "H": 137.05891, "I": 113.08406, "K": 128.09496, "L": 113.08406,
    "M": 131.04049, "N": 114.04293, "P": 97.05276, "Q": 128.05858, "R": 156.10111, "S": 87.03203, "T": 101.04768, "V": 99.06841, "W": 186.07931, "Y": 163.06333,
}


def to_float(c: Column) -> Column:
    """Thousands commas dropped; NaN, infinities, hexadecimal and suffixed numbers are null."""
    t = F.replace(F.trim(c.cast("string")), F.lit(","), F.lit(""))
    return F.when(t.rlike(FLOAT), t.try_cast("double"))


def to_int(c: Column) -> Column:
    """Only within 1e-9 of a whole number."""
    v = to_float(c)
    return F.when(F.abs(v - F.round(v)) < 1e-9, F.round(v).cast("bigint"))


def flag(c: Column, wide: bool = False) -> Column:
    words = ["1", "true", "yes", "y"] + (["t"] if wide else [])
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(words), F.lit(False)).cast("int")


def median_of(values: Column) -> Column:
    """Exact median of an array: the mean of the middle two where the count is even."""
    s = F.array_sort(values)
    n = F.size(s)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def numbers_in(text: Column, pattern: str = r"[-+]?\d+(?:\.\d+)?") -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: x.try_cast("double"))


def first_number(text: Column) -> Column:
    n = F.regexp_extract(text, r"[-+]?\d+(?:\.\d+)?", 0)
    return F.when(n != "", n.try_cast("double"))


def mass_of_text(mass: Column, mz: Column) -> Column:
    """First number of the mass text, else of the m/z text."""
    return F.coalesce(first_number(mass), first_number(mz))


def mass_of_sequence(seq: Column) -> Column:
    """Monoisotopic mass of a canonical sequence; null for the empty or another one."""
    table = F.create_map(*[F.lit(x) for kv in RESIDUE_MASS.items() for x in kv])
    total = F.aggregate(F.split(seq, ""), F.lit(WATER), lambda a, r: a + F.coalesce(table[r], F.lit(0.0)))
    return F.when(seq.rlike("^[ACDEFGHIKLMNPQRSTVWY]+$"), total)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once; repeated expressions would be compiled over and over."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _whole(x: Column, scale: Column) -> Column:
    """The whole number nearest to ``x * scale``, of the exact product: halves of it go to the even one.

    A product is rounded to a double itself; its error, got without loss from the halves of both factors, tells on
    which side of a half the exact product lies. ``scale`` must be a whole number of at most 53 bits, exactly.
    """
    def high(v: Column) -> Column:
        return _let(v * F.lit(134217729.0), lambda c: c - (c - v))

    def nearest(p: Column, xh: Column, sh: Column) -> Column:
        error = ((xh * sh - p) + xh * (scale - sh) + (x - xh) * sh) + (x - xh) * (scale - sh)

        def up(low: Column, e: Column) -> Column:
            return low + F.when((p - low > 0.5) | ((p - low == 0.5) & ((e > 0) | ((e == 0) & (low % 2 != 0)))), 1.0).otherwise(0.0)

        return _let(F.floor(p).cast("double"), lambda low: _let(error, lambda e: up(low, e)))

    return _let(x * scale, lambda p: _let(high(x), lambda xh: _let(high(scale), lambda sh: nearest(p, xh, sh))))


def rounded(c: Column, digits: int) -> Column:
    """To so many decimals, by the exact binary value; what ``%.<digits>f`` shows."""
    scale = F.lit(10.0**digits)
    return _let(c.cast("double"), lambda x: F.when(F.abs(x) < 1e9, F.signum(x) * _let(F.abs(x), lambda v: _whole(v, scale)) / scale).otherwise(x))


def significant(c: Column, digits: int = 6) -> Column:
    """So many significant digits, by the exact binary value; the number that ``%.<digits>g`` shows."""
    def large(x: Column, down: Column) -> Column:
        # Whole multiples of the power and their halves are exact for numbers of up to 53 bits.
        return _let(F.floor(x / down).cast("double"), lambda q: (q + F.when((x > (q + 0.5) * down) | ((x == (q + 0.5) * down) & (q % 2 != 0)), 1.0).otherwise(0.0)) * down)

    def shown(x: Column, k: Column) -> Column:
        small = _let(F.pow(F.lit(10.0), F.greatest(k, F.lit(0))), lambda up: _whole(x, up) / up)
        return F.when(k > 0, small).otherwise(_let(F.pow(F.lit(10.0), F.greatest(-k, F.lit(0))), lambda down: large(x, down)))

    def sized(v: Column) -> Column:
        return F.signum(v) * _let(F.abs(v), lambda x: _let((digits - 1) - F.floor(F.log10(x)), lambda k: shown(x, k)))

    return _let(c.cast("double"), lambda v: F.when(v == 0, 0.0).otherwise(sized(v)))


def sig6(c: Column) -> Column:
    """Six significant digits, as a number."""
    return significant(c, 6)


def g_text(c: Column, digits: int = 6) -> Column:
    """``%.<digits>g``: that many significant digits, no trailing zeros, an exponent below 1e-4 or from 10^digits on."""
    def bare(t: Column) -> Column:
        return F.regexp_replace(t, r"\.?0+$", "")

    def written(shown: Column) -> Column:
        exponent = F.regexp_extract(shown, r"e([+-][0-9]+)$", 1).cast("int")
        mantissa = F.regexp_extract(shown, "^(.*)e", 1)
        power = F.concat(F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
        return F.when((exponent < -4) | (exponent >= digits), F.concat(bare(mantissa), power)).otherwise(bare(F.format_string(f"%.{digits + 4}f", shown.cast("double"))))

    return F.when(c == 0, "0").otherwise(_let(F.format_string(f"%.{digits - 1}e", significant(c, digits)), written))


def percent_text(part: Column, whole: Column) -> Column:
    """``12.34%``; of nothing it is ``0.00%``."""
    return F.when(whole == 0, "0.00%").otherwise(F.format_string("%.2f%%", rounded(F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * 100, 2)))


def spread(low: Column, high: Column) -> Column:
    """Ratio of the greatest to the least value; null unless the least is above 0."""
    return F.when(low > 0, high / low)


def log10_positive(c: Column) -> Column:
    return F.when(c > 0, F.log10(c))


def geometric_mean(values: Column) -> Column:
    """Null for no values or one not above 0."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.log(x))
    return F.when((F.size(values) > 0) & (F.array_min(values) > 0), F.exp(total / F.size(values)))
