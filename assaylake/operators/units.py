"""Quantities in different units to common units, as one SQL plan.

Number and unit are extracted by regular expression from the plain form of the text; the unit is the one in
the text, else the one of the unit field, else the source's default; its spelling is normalised by a join with
an alias table of fixed size (built by rule, so broadcasting it is safe at any scale); then factor and offset
of the unit apply. No shuffle: a scan, two broadcast joins and projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.plain import once, plain
from assaylake.functions.text import MISSING_TOKENS

# Number grammar. Thousands commas stand before three digits, a decimal comma before one or two.
NUMBER = r"(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+,\d{1,2}|\d+(?:\.\d+)?|\.\d+)"
EXPONENT = r"(?:[eE]([+-]?\d+)|\s*[x×*]\s*10\s*\^?\s*([+-]?\d+))?"
ERROR = r"(?:\s*(?:±|\+/-|\+-)\s*" + NUMBER + r"(?:[eE][+-]?\d+)?)?"
SINGLE = rf"^({NUMBER}){EXPONENT}{ERROR}\s*(.*)$"
RANGE = (
    rf"^({NUMBER}){EXPONENT}{ERROR}\s*(?:([A-Za-zμ%][A-Za-zμ%/]*)(?:\s*~\s*|\s+(?:-|to)\s+)|-\s*|~\s*|to\s+)"
    rf"({NUMBER}){EXPONENT}{ERROR}\s*(.*)$"
)
LEAD = r"(?i)^\s*(?:ic\s?50\s*(?:value)?\s*[:=]?\s*)?(?:(?:<=|>=|=<|=>|[<>≤≥~≈=]|ca\.?|circa|about|approx\.?)\s*)*"

# Decimal exponents of prefixes and volumes, and words for them.
PREFIXES = {"p": -12, "n": -9, "u": -6, "m": -3, "": 0}
PREFIX_WORDS = {"pico": "p", "nano": "n", "micro": "u", "milli": "m", "": ""}
VOLUMES = {"l": 0, "dl": -1, "ml": -3, "ul": -6, "100ml": -1}
MASS_TO_DALTON = {"": 1.0, "da": 1.0, "dalton": 1.0, "daltons": 1.0, "g/mol": 1.0, "gmol-1": 1.0, "u": 1.0, "kda": 1000.0, "kilodalton": 1000.0, "kilodaltons": 1000.0, "kg/mol": 1000.0, "kgmol-1": 1000.0}


def unit_rows() -> list[tuple[str, str, str, float, float]]:
    """(alias, dimension, unit, factor to the common unit, offset); common: nM, g/l, degree Celsius."""
    rows: dict[str, tuple[str, str, float, float]] = {}

    def per(stem: str, dim: str, name: str, exp: int) -> None:
        for v, e in VOLUMES.items():
            for alias in (f"{stem}/{v}", f"{stem}{v}-1", f"{stem}{v}^-1", f"{stem}per{v}"):
                rows[alias] = (dim, f"{name}/{v}", 10.0 ** (exp - e), 0.0)

    for p, e in PREFIXES.items():
        rows["M" if not p else f"{p}m"] = ("molar", f"{p}M", 10.0 ** (e + 9), 0.0)
        for stem in ("mol", "mole", "moles"):
            per(p + stem, "molar", p + "mol", e + 9)
        per(p + "g", "mass", p + "g", e)
    for word, p in PREFIX_WORDS.items():
        rows[word + "molar"] = ("molar", f"{p}M", 10.0 ** (PREFIXES[p] + 9), 0.0)
        for stem in ("mol", "mole", "moles"):
            per(word + stem, "molar", p + "mol", PREFIXES[p] + 9)
        for stem in ("gram", "grams"):
            per(word + stem, "mass", p + "g", PREFIXES[p])
    per("mcg", "mass", "ug", -6)
    rows |= {"°c": ("temperature", "C", 1.0, 0.0), "c": ("temperature", "C", 1.0, 0.0), "k": ("temperature", "K", 1.0, -273.15), "°f": ("temperature", "F", 5 / 9, -160 / 9)}
    return [(a, *r) for a, r in rows.items()]


def unit_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(unit_rows(), "alias string, dimension string, unit string, factor double, offset double")


def unit_key(unit: Column) -> Column:
    """Spelling reduced to the alias form: no spaces, ``u`` for the micro sign, lower case but for a lone M."""
    k = F.regexp_replace(F.translate(unit, "μ", "u"), r"[\s·]+", "")
    return F.when(k == "M", k).when(k == "m", F.lit("metre")).otherwise(F.lower(k))


def quantity(text: Column) -> Column:
    """Struct (kind, value, upper, unit_text, unit_low, unit_high) of a potency text in plain form.

    kind: missing, bare, single, percent, range or bad. Labels, relation signs, errors and bracketed remarks
    are ignored. ``unit_text`` still has to be looked up; ``value`` is null where no number is read.
    In a range each end has its own unit, or the one that is written.
    """
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)|\[[^\]]*\]", ""), LEAD, ""))

    def number(n: Column) -> Column:
        n = F.when(n.rlike(r"^\d+,\d{1,2}$"), F.replace(n, F.lit(","), F.lit("."))).otherwise(F.replace(n, F.lit(","), F.lit("")))
        return n.try_cast("double")

    def part(pattern: str, g: int) -> Column:
        return F.regexp_extract(t, pattern, g)

    def scaled(pattern: str, g: int) -> Column:
        """The number may carry powers of ten; they are applied as a text exponent, so that 1.5e-5 stays exact."""
        exp = F.coalesce(F.concat(part(pattern, g + 1), part(pattern, g + 2)).try_cast("int"), F.lit(0))
        n = number(part(pattern, g))
        return F.when(exp == 0, n).otherwise(F.concat(n.cast("string"), F.lit("E"), exp.cast("string")).try_cast("double"))

    single, ranged = t.rlike(SINGLE), t.rlike(RANGE)
    unit = F.trim(part(SINGLE, 4))
    tail, middle = F.nullif(F.trim(part(RANGE, 8)), F.lit("")), F.nullif(part(RANGE, 4), F.lit(""))
    return F.when(text.isNull() | F.lower(F.trim(text)).isin(MISSING_TOKENS), _quantity("missing")).when(
        ranged, _quantity("range", scaled(RANGE, 1), scaled(RANGE, 5), F.concat_ws(" ", tail, middle), F.coalesce(middle, tail), F.coalesce(tail, middle))
    ).when(
        single, _quantity(F.when(unit == "", "bare").when(unit.rlike("^%"), "percent").otherwise("single"), scaled(SINGLE, 1), None, unit)
    ).otherwise(_quantity("bad"))


def parse_potency(df: DataFrame, raw: str) -> DataFrame:
    """Adds ``q``, the :func:`quantity` of the plain form of ``raw``, evaluated once a row."""
    kept = [c for c in df.columns if c not in ("q", "q_text", "q_field")]
    return df.select(*kept, once(plain(F.col(raw))).alias("q_text")).select(*kept, once(quantity(F.col("q_text"))).alias("q"))


def _quantity(kind: Column | str, value: Column | None = None, upper: Column | None = None, unit: Column | None = None, low: Column | None = None, high: Column | None = None) -> Column:
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        (F.lit(None).cast("double") if value is None else value).alias("value"),
        (F.lit(None).cast("double") if upper is None else upper).alias("upper"),
        (F.lit("") if unit is None else unit).alias("unit_text"),
        (F.lit(None).cast("string") if low is None else low).alias("unit_low"),
        (F.lit(None).cast("string") if high is None else high).alias("unit_high"),
    )


def mass_unit_key(raw: Column) -> Column:
    """The unit behind the number of a mass text, in alias form; empty where none is written."""
    return F.lower(F.regexp_replace(F.regexp_extract(plain(raw), r"^\s*[\d.,]+\s*([A-Za-z][A-Za-z/\-1 ]*)", 1), r"\s", ""))


def convert_potency(
    df: DataFrame, raw: str = "ic50_raw", unit: str = "ic50_unit", mass: str = "mass_da", mass_raw: str = "mass_raw",
    source: str = "source_name", source_defaults: dict[str, str] | None = None,
) -> DataFrame:
    """Adds ``q_kind, q_value, q_unit, q_dimension, q_unit_from, q_mass_da, q_nm, q_low_nm, q_high_nm`` and keeps all columns and rows.

    ``q_nm`` (nanomolar) is null, the row left open, when the text is no single positive number, no unit is
    known, or a mass concentration lacks a positive mass. ``q_low_nm`` and ``q_high_nm`` are the ends of a range,
    the smaller first, both or neither; ``q_unit`` and ``q_dimension`` of a range are those of its last end. Null, empty and very long texts are open rows too.
    ``q_low_dimension`` is that of the first end. Added names that clash with input columns replace them.
    """
    spark = df.sparkSession
    default = F.lit(None).cast("string")
    for name, u in (source_defaults or {}).items():
        default = F.when(F.col(source) == name, F.lit(u)).otherwise(default)
    parsed = parse_potency(df, raw)
    parsed = parsed.select("*", once(F.trim(plain(F.col(unit)))).alias("q_field"))
    unit_field = F.when(~F.lower("q_field").isin(MISSING_TOKENS), F.col("q_field"))
    ranged = F.col("q.kind") == "range"
    own = F.when(F.col("q.kind") == "single", F.col("q.unit_text")).when(ranged, F.col("q.unit_high"))
    bare = (F.col("q.kind") == "bare") | (ranged & own.isNull())
    parsed = parsed.withColumns(
        {
            "q_unit": F.coalesce(own, F.when(bare, F.coalesce(unit_field, default))),
            "q_unit_from": F.when(own.isNotNull(), "text").when(bare & unit_field.isNotNull(), "field").when(bare & default.isNotNull(), "source"),
            "q_mass_alias": mass_unit_key(F.col(mass_raw)),
        }
    ).withColumns({"q_alias": unit_key(F.col("q_unit")), "q_low_alias": unit_key(F.coalesce(F.when(ranged, F.col("q.unit_low")), F.col("q_unit")))})
    units = F.broadcast(unit_table(spark).select(F.col("alias").alias("q_alias"), F.col("dimension").alias("q_dimension"), F.col("factor").alias("q_factor"), F.col("offset").alias("q_offset")))
    low_units = units.toDF("q_low_alias", "q_low_dimension", "q_low_factor", "q_low_offset")
    masses = spark.createDataFrame(list(MASS_TO_DALTON.items()), "q_mass_alias string, q_mass_factor double")
    joined = parsed.join(units, "q_alias", "left").join(F.broadcast(low_units), "q_low_alias", "left").join(F.broadcast(masses), "q_mass_alias", "left")
    # Dalton unless the text writes another unit of mass.
    in_dalton = F.col(mass) * F.coalesce("q_mass_factor", F.lit(1.0))
    joined = joined.withColumn("q_mass_da", F.when(~F.isnan(mass) & (F.col(mass) > 0), in_dalton))

    def in_nm(value: Column, at: str) -> Column:
        common = value * F.col(f"{at}_factor") + F.col(f"{at}_offset")
        dimension = F.col(f"{at}_dimension")
        return F.when(value > 0, F.when(dimension == "molar", common).when(dimension == "mass", common * 1e9 / F.col("q_mass_da")))

    first, last = in_nm(F.col("q.value"), "q_low"), in_nm(F.col("q.upper"), "q")
    both = ranged & first.isNotNull() & last.isNotNull()
    return joined.withColumns(
        {"q_kind": F.col("q.kind"), "q_value": F.col("q.value"), "q_nm": F.when(F.col("q.kind").isin("single", "bare"), in_nm(F.col("q.value"), "q")),
         "q_low_nm": F.when(both, F.least(first, last)), "q_high_nm": F.when(both, F.greatest(first, last))}
    ).drop("q", "q_field", "q_alias", "q_offset", "q_low_alias", "q_low_factor", "q_low_offset", "q_mass_alias", "q_mass_factor")


def half_up(x: Column) -> Column:
    """Whole number, halves up; a binary error below a millionth does not move a half."""
    return F.floor(F.round(x, 6) + F.lit(0.5)).cast("bigint")


def is_micromolar(dimension: Column, factor: Column) -> Column:
    return (dimension == "molar") & (factor == 1000.0)

