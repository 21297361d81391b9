"""Potency parsers, one per source; each is a struct column, so a text is read once.

The sources keep separate grammars on purpose: what is exact in one is ambiguous in another. Every text gets
exactly one status. ``with_reading`` is the way in: it stages the work and evaluates it once a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.numeric import MASS_TO_UM, MOLAR_TO_UM, median_of, numbers_in
from assaylake.functions.plain import once
from assaylake.functions.text import clean_text, normalize_spaces

# Numbers and units of the grammars, and the spellings of units that are the same, in order.
NUM = r"([0-9]+(?:\.[0-9]+)?)"
MOLAR = r"(nM|uM|mM|M)"
MASS = r"(ng/mL|ug/mL|mg/mL)"
UNIT_CASES = [
    ("μ", "u"), ("µ", "u"), ("UM", "uM"), ("NM", "nM"), ("MM", "mM"), ("ug/ml", "ug/mL"), ("mg/ml", "mg/mL"), ("ng/ml", "ng/mL"),
    ("UG/ML", "ug/mL"), ("MG/ML", "mg/mL"), ("NG/ML", "ng/mL"),
]
FIELDS = "status string, relation string, value double, low double, high double, unit string, um double, exact int, note string"


def _struct(**given) -> Column:
    out = []
    for f in FIELDS.split(", "):
        name, kind = f.split(" ")
        v = given.get(name, 0 if name == "exact" else None)
        out.append((v if isinstance(v, Column) else F.lit(v)).cast(kind).alias(name))
    return F.struct(*out)


def unit_case_preserving(c: Column) -> Column:
    """Micro signs to ``u``; upper-case molar units and lower-case per-mL units to their usual case."""
    return reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), UNIT_CASES, F.trim(c))


def unit_lower(c: Column) -> Column:
    """Lower case, no spaces, ``u`` for micro signs, ``/l`` for ``l-1``."""
    return reduce(lambda t, s: F.replace(t, F.lit(s[0]), F.lit(s[1])), [("μ", "u"), ("µ", "u"), ("l-1", "/l"), (" ", "")], F.lower(c))


def relation_of(c: Column) -> Column:
    r = F.regexp_extract(F.trim(c), "^([<>≤≥])", 1)
    return F.when(r != "", r).otherwise("=")


def molar_factor(unit: Column) -> Column:
    return F.coalesce(*[F.when(unit == u, F.lit(f)) for u, f in MOLAR_TO_UM.items()])


def _double(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def _common(norm: Column, names: dict[str, str]) -> list[tuple[Column, Column]]:
    """Cases range, mass, threshold and exact, which two sources share under different names."""
    ranged, mass = rf"^{NUM}\s*[-~]\s*{NUM}\s*{MOLAR}$", rf"^([<>≤≥])?\s*{NUM}\s*{MASS}$"
    limit, exact = rf"^([<>≤≥])\s*{NUM}\s*{MOLAR}$", rf"^{NUM}\s*{MOLAR}$"

    def part(p: str, g: int) -> Column:
        return F.regexp_extract(norm, p, g)

    return [
        (norm.rlike(ranged), _struct(status=names["range"], low=_double(norm, ranged, 1), high=_double(norm, ranged, 2), unit=part(ranged, 3), note="range")),
        (norm.rlike(mass), _struct(status=names["mass"], relation=relation_of(norm), value=_double(norm, mass, 2), unit=part(mass, 3), note="mass_concentration")),
        (norm.rlike(limit), _struct(status=names["threshold"], relation=part(limit, 1), value=_double(norm, limit, 2), unit=part(limit, 3), um=_double(norm, limit, 2) * molar_factor(part(limit, 3)), note="molar_threshold")),
        (norm.rlike(exact), _struct(status=names["exact"], relation="=", value=_double(norm, exact, 1), unit=part(exact, 2), um=_double(norm, exact, 1) * molar_factor(part(exact, 2)), exact=1, note="exact_molar")),
    ]


def _decide(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    first, *rest = cases
    out = F.when(*first)
    for c in rest:
        out = out.when(*c)
    return out.otherwise(otherwise)


def _prepare_ahtpdb(text: Column) -> Column:
    return unit_case_preserving(text)


def _decide_ahtpdb(text: Column, norm: Column) -> Column:
    """missing, percent, suspicious_unit, dirty (also a number written twice), range, mass_unit, threshold, exact."""
    compact = F.replace(norm, F.lit(" "), F.lit(""))
    odd = r"([<>≤≥])?\s*" + NUM
    twice = rf"^{NUM}\s+\1$"
    return _decide(
        [
            (text.isNull(), _struct(status="missing")),
            (compact.contains("%"), _struct(status="percent", value=_double(compact, NUM, 1), unit=text, note="percent")),
            (compact.rlike(r"(?:nM|uM|mM|M)/L"), _struct(status="suspicious_unit", relation=F.coalesce(F.nullif(F.regexp_extract(norm, odd, 1), F.lit("")), F.lit("=")), value=_double(norm, odd, 2), unit=text, note="molar_per_litre")),
            (norm.rlike(twice), _struct(status="dirty", value=_double(norm, twice, 1), unit=text, note="number_twice")),
            *_common(norm, {"range": "range", "mass": "mass_unit", "threshold": "threshold", "exact": "exact"}),
        ],
        _struct(status="dirty", unit=text, note="unparsed"),
    )


def _prepare_biopep(text: Column) -> Column:
    return unit_case_preserving(F.regexp_replace(text, r"\s*\[[^\]]+\]\s*$", ""))


def _decide_biopep(text: Column, work: Column) -> Column:
    """Bare numbers have no unit; then percent, range, mass, threshold, exact, any number, nothing."""
    return _decide(
        [
            (text.isNull(), _struct(status="missing")),
            (work.rlike(rf"^{NUM}$"), _struct(status="numeric_no_unit", relation="=", value=_double(work, NUM, 1), note="no_unit")),
            (work.contains("%"), _struct(status="percent_like", value=_double(work, NUM, 1), note="percent")),
            *_common(work, {"range": "range", "mass": "mass_unit", "threshold": "molar_threshold", "exact": "exact_molar"}),
            (work.rlike(NUM), _struct(status="ambiguous_text", value=_double(work, NUM, 1), note="number_not_safe")),
        ],
        _struct(status="unparsed_text", note="no_number"),
    )


def parse_detail_text(text: Column) -> Column:
    """Potency within running text: a labelled value, a sentence about it, else a labelled bare number."""
    unit = r"(µM|μM|uM|nM|mM|M|micromole|micromolar)\b"
    label = rf"(?i)\bIC50\s*:?\s*([<>≤≥]?)\s*{NUM}\s*{unit}"
    sentence = rf"(?i)\bIC50\b.*?\b(?:was|is|of)\s*([<>≤≥]?)\s*{NUM}\s*{unit}"
    bare = rf"(?i)\bIC50\s*:?\s*([<>≤≥]?)\s*{NUM}\b"

    def found(p: str) -> Column:
        low = F.lower(F.translate(F.regexp_extract(text, p, 3), "µμ", "uu"))
        u = F.when(low.isin("um", "micromole", "micromolar"), "uM").when(low == "nm", "nM").when(low == "mm", "mM").when(low == "m", "M")
        rel = F.coalesce(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), F.lit("="))
        v = _double(text, p, 2)
        return _struct(status=F.when(rel == "=", "exact_molar").otherwise("molar_threshold"), relation=rel, value=v, unit=u, um=v * molar_factor(u), note="from_text")

    rel = F.coalesce(F.nullif(F.regexp_extract(text, bare, 1), F.lit("")), F.lit("="))
    return _decide(
        [(text.rlike(label), found(label)), (text.rlike(sentence), found(sentence)), (text.rlike(bare), _struct(status="numeric_no_unit", relation=rel, value=_double(text, bare, 2), note="no_unit"))],
        _struct(status="missing", note="not_found"),
    )


def _molar_or_mass(work: Column, advanced: bool) -> Column:
    """Unit of a lower-case, space-free text, by priority: mass, then mM, uM, nM, pM, mol/l."""
    end = "(?![a-z])" if advanced else r"\b"
    mass = []
    for p in "mun":
        hit = work.contains(f"{p}g/ml")
        mass.append(F.when(hit if advanced else hit | work.contains(f"{p}gperml"), F.lit(f"{p}g/ml")))
    molar = []
    for p in "munp":
        hit = work.contains(f"{p}mol/l") | work.rlike(f"(?<![a-z]){p}m{end}")
        if advanced and p == "u":
            hit = hit | work.contains("micromolar")
        molar.append(F.when(hit, F.lit(f"{p}M")))
    return F.coalesce(*mass, *molar, F.when(work.contains("mol/l"), F.lit("M")))


def _prepare_fermfood(text: Column, advanced: bool = False) -> Column:
    work = F.regexp_replace(unit_lower(text), r"^[<>≤≥]+\s*", "")
    work = F.regexp_replace(work, r"(\d+(?:\.\d+)?)\s*±\s*\d+(?:\.\d+)?", "$1")
    if advanced:
        work = F.regexp_replace(F.replace(work, F.lit("mcg"), F.lit("ug")), r"(\d+(?:\.\d+)?)\s*\+/-\s*\d+(?:\.\d+)?", "$1")
    return normalize_spaces(F.regexp_replace(work, r"\(([^)]*)\)", " "))


def _decide_fermfood(text: Column, rel: Column, values: Column, unit: Column, mass_da: Column) -> Column:
    """All numbers of the text, their median, and one unit; a mass concentration needs a mass.

    A range's hyphen counts as a sign and a label's digits as numbers, as in the tables this grammar comes from.
    """
    median = median_of(values)
    mass_unit = unit.isin(*MASS_TO_UM)
    per_mass = F.coalesce(*[F.when(unit == u, F.lit(f)) for u, f in MASS_TO_UM.items()])
    um = F.when(mass_unit, median * (per_mass / mass_da)).otherwise(median * molar_factor(unit))
    return _decide(
        [
            (text.isNull(), _struct(status="missing")),
            (F.size(values) == 0, _struct(status="unparsed_text", relation=rel, note="no_number")),
            (unit.isNull(), _struct(status="numeric_no_unit", relation=rel, value=median, note="no_unit")),
            (mass_unit & ~F.coalesce(mass_da > 0, F.lit(False)), _struct(status="mass_concentration_needs_mass", relation=rel, value=median, unit=unit, note="no_mass")),
        ],
        _struct(status=F.when(rel == "=", "exact_molar").otherwise("molar_threshold"), relation=rel, value=median, unit=unit, um=um, note=F.when(F.size(values) > 1, "median_of_several").otherwise("single_value")),
    )


def _prepare_mbpdb(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s*[<>≤≥]\s*", ""), r"(^|\s)\d+\)\s*", "$1")


def _decide_mbpdb(text: Column, rel: Column, values: Column) -> Column:
    """Always micromolar: list numbers like ``1)`` are dropped, several values give their median."""
    median = median_of(values)
    return _decide(
        [(text.isNull(), _struct(status="missing")), (F.size(values) == 0, _struct(status="unparsed_text", note="no_number"))],
        _struct(
            status=F.when(rel == "=", "exact_molar").otherwise("molar_threshold"), relation=rel, value=median, low=F.array_min(values), high=F.array_max(values), unit="uM", um=median,
            note=F.when(F.size(values) > 1, "median_of_several").otherwise("single_value"),
        ),
    )


#: Grammars by source name; ``advanced`` also reads ``+/-`` errors, ``micromolar`` and looser unit boundaries.
PREPARE = {"AHTPDB": _prepare_ahtpdb, "BIOPEP": _prepare_biopep, "MBPDB": _prepare_mbpdb, "FermFooDb": _prepare_fermfood, "advanced": lambda t: _prepare_fermfood(t, True)}


def with_reading(df: DataFrame, grammar: str | dict[str, Column], raw: str = "ic50_raw", mass: Column | None = None, name: str = "p") -> DataFrame:
    """The rows with the reading of ``raw``; ``grammar`` is one name, or names with the rows they hold for.

    Cleaned text, working text, numbers and decision are stages behind generators of one row, so no later
    filter evaluates a text twice and each stage stays small enough to be compiled.
    """
    cases = {grammar: F.lit(True)} if isinstance(grammar, str) else grammar
    mass = F.lit(None).cast("double") if mass is None else mass

    def choose(part) -> Column:
        out = None
        for g, where in cases.items():
            out = F.when(where, part(g)) if out is None else out.when(where, part(g))
        return out

    def numeric(g: str) -> Column:
        none = F.lit(None).cast("array<double>"), F.lit(None).cast("string")
        values, unit = none if g in ("AHTPDB", "BIOPEP") else (numbers_in(F.col("_w")), none[1] if g == "MBPDB" else _molar_or_mass(F.col("_w"), g == "advanced"))
        return F.struct(values.alias("v"), unit.alias("u"))

    def decide(g: str) -> Column:
        t, w, v, u = F.col("_t"), F.col("_w"), F.col("_n.v"), F.col("_n.u")
        if g in ("AHTPDB", "BIOPEP"):
            return (_decide_ahtpdb if g == "AHTPDB" else _decide_biopep)(t, w)
        return _decide_mbpdb(t, relation_of(t), v) if g == "MBPDB" else _decide_fermfood(t, relation_of(t), v, u, mass)

    kept = df.columns
    rows = df.select("*", once(clean_text(F.col(raw))).alias("_t"))
    rows = rows.select("*", once(choose(lambda g: PREPARE[g](F.col("_t")))).alias("_w"))
    rows = rows.select("*", once(choose(numeric)).alias("_n"))
    return rows.select(*kept, once(choose(decide)).alias(name))


def mass_to_um(status: Column, relation: Column, value: Column, unit: Column, mass: Column) -> Column:
    """Micromolar of an eligible mass concentration: plain relation, positive value and mass, mg or ug per mL."""
    ok = F.coalesce(status == "mass_unit", F.lit(False)) & (relation == "=") & (value > 0) & (mass > 0)
    return F.when(ok & (F.lower(unit) == "mg/ml"), value * 1e6 / mass).when(ok & (F.lower(unit) == "ug/ml"), value * 1e3 / mass)


# Statuses of a stored reading that any resolved one replaces.
WEAK = ["", "missing", "numeric_no_unit", "ambiguous_text", "unparsed_text", "percent_like", "range", "mass_unit"]
RESOLVED = ["exact_molar", "molar_threshold"]


def stronger(new_status: Column, old_status: Column, old_um: Column, old_unit: Column, new_unit: Column) -> Column:
    """A resolved reading of a detail text replaces a weak one, one without a value, or one without unit."""
    weak = F.coalesce(old_status, F.lit("")).isin(*WEAK)
    return F.coalesce(new_status.isin(*RESOLVED), F.lit(False)) & (weak | old_um.isNull() | (old_unit.isNull() & new_unit.isNotNull()))


def better(new_status: Column, new_um: Column, old_status: Column, old_um: Column) -> Column:
    """A resolved reading by the improved rules replaces one that is not resolved, or one of another value."""
    old = F.coalesce(old_status.isin(*RESOLVED), F.lit(False)) & old_um.isNotNull()
    new = F.coalesce(new_status.isin(*RESOLVED), F.lit(False)) & new_um.isNotNull()
    return new & (~old | (new_um != old_um))


# What a conversion writes beside the value.
CONVERSIONS = {
    "mg/ml": ("uM = (mg/mL * 1000000) / molwt_value", "mass_unit_mg_per_mL_converted_to_uM"),
    "ug/ml": ("uM = (ug/mL * 1000) / molwt_value", "mass_unit_ug_per_mL_converted_to_uM"),
}


def convert_mass_units(df: DataFrame) -> DataFrame:
    """The master with eligible mass concentrations turned into exact micromolar values, and what was done.

    Adds unit_conversion_applied, _from_unit, _to_unit, _formula and _note (empty where nothing was done); the raw
    fields stay. :func:`conversion_log` lists the converted rows.
    """
    unit = F.replace(F.lower(F.replace(F.replace(F.col("ic50_unit_raw"), F.lit("μ"), F.lit("u")), F.lit("µ"), F.lit("u"))), F.lit(" "), F.lit(""))
    um = mass_to_um(F.lower("ic50_type"), F.col("ic50_relation"), F.col("ic50_value"), unit, F.col("molwt_value"))
    rows = df.withColumn("_um", once(um))
    done = F.col("_um").isNotNull()
    said = {c: F.coalesce(*[F.when(done & (unit == u), F.lit(v[i])) for u, v in CONVERSIONS.items()], F.lit("")) for i, c in enumerate(("formula", "note"))}
    return rows.withColumns({
        "unit_conversion_applied": done.cast("int"), "unit_conversion_from_unit": F.when(done, F.col("ic50_unit_raw")).otherwise(""), "unit_conversion_to_unit": F.when(done, "uM").otherwise(""),
        "unit_conversion_formula": said["formula"], "unit_conversion_note": said["note"], "ic50_type_before": F.col("ic50_type"),
    }).withColumns({
        "ic50_type": F.when(done, "exact").otherwise(F.col("ic50_type")), "ic50_uM": F.coalesce("_um", "ic50_uM"), "ic50_exact_flag": F.when(done, 1).otherwise(F.col("ic50_exact_flag")),
    }).drop("_um")


def conversion_log(converted: DataFrame) -> DataFrame:
    """One row per converted record: what it was, what it became, and by which formula."""
    return converted.where("unit_conversion_applied = 1").select(
        "id", "sequence_clean", "table_from", "ic50_raw", "ic50_type_before", F.col("unit_conversion_from_unit").alias("from_unit"), "ic50_value", "molwt_value", "ic50_uM",
        "unit_conversion_formula", "unit_conversion_note",
    )
