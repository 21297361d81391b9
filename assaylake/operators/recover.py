"""Loading of broken delimited lines: typed records, and located errors with a reason.

The text of a row is read by a recursive-descent grammar (blob -> record -> field -> quoted | bare). A syntax
error ends the record with the position of the fault; the grammar then resumes at the next validated anchor: a
line start that looks like the start of a record and from which a well-formed record of the right number of fields
can be read. So one broken quote cannot swallow the records behind it, and a line start inside a quoted field is not
taken for a record. Only rows with a quote or an inner line end go to Python, on Arrow batches; all other rows are a
plain split, and values are typed and validated by built-in expressions. One scan, no shuffle.

Defined results: null and empty texts are one record without fields (``column_count``); texts of any length
are read whole; a trailing line end belongs to the record; where no record can be validated behind a fault the rest
of the text belongs to the faulty record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.plain import once, plain
from assaylake.operators.units import parse_potency, unit_key, unit_table


class Fault(Exception):
    """A syntax error at a position of the text."""

    def __init__(self, reason: str, at: int):
        super().__init__(reason)
        self.reason, self.at = reason, at


@dataclass(frozen=True)
class Grammar:
    """Delimited records: a quote stands only around a whole field and is doubled inside one."""

    anchor: str
    sep: str = ","
    quote: str = '"'
    #: Fields of a record behind an anchor; none: any number.
    width: int | None = None

    def blob(self, text: str) -> Iterator[tuple[int, list[str] | None, str | None, int | None]]:
        """(start, fields, reason, fault position) of each record; a faulty one has no fields."""
        anchors = re.compile(rf"(?m)^(?={self.anchor})")
        end = len(text)
        while end and text[end - 1] in "\r\n":
            end -= 1
        at = 0
        while True:
            try:
                fields, after = self.record(text, at, end)
                yield at, fields, None, None
            except Fault as fault:
                yield at, None, fault.reason, fault.at
                resumed = self.resume(text, at + 1, end, anchors)  # behind the record's start: an open quote may have run over anchors
                if resumed is None:
                    return
                after = resumed
            if after >= end:
                return
            at = after

    def resume(self, text: str, at: int, end: int, anchors: re.Pattern) -> int | None:
        """The first anchor behind which a whole record stands."""
        for found in anchors.finditer(text, at, end):
            try:
                fields, _ = self.record(text, found.start(), end)
            except Fault:
                continue
            if self.width is None or len(fields) == self.width:
                return found.start()
        return None

    def record(self, text: str, at: int, end: int) -> tuple[list[str], int]:
        fields = []
        while True:
            value, at = self.field(text, at, end)
            fields.append(value)
            if at >= end:
                return fields, end
            if text[at] == self.sep:
                at += 1
                continue
            return fields, at + (2 if text.startswith("\r\n", at) else 1)

    def field(self, text: str, at: int, end: int) -> tuple[str, int]:
        return self.quoted(text, at, end) if at < end and text[at] == self.quote else self.bare(text, at, end)

    def quoted(self, text: str, at: int, end: int) -> tuple[str, int]:
        opened, parts, at = at, [], at + 1
        while True:
            close = text.find(self.quote, at, end)
            if close < 0:
                raise Fault("quoting", opened)
            parts.append(text[at:close])
            at = close + 1
            if at < end and text[at] == self.quote:
                parts.append(self.quote)
                at += 1
                continue
            if at >= end or text[at] == self.sep or text[at] in "\r\n":
                return "".join(parts), at
            raise Fault("quoting", at)

    def bare(self, text: str, at: int, end: int) -> tuple[str, int]:
        stop = end
        for mark in (self.sep, "\n"):
            found = text.find(mark, at, stop)
            if found >= 0:
                stop = found
        stray = text.find(self.quote, at, stop)
        if stray >= 0:
            raise Fault("quoting", stray)
        if stop < end and text[stop] == "\n" and stop > at and text[stop - 1] == "\r":
            stop -= 1
        return text[at:stop], stop


RECORDS = "array<struct<start:bigint,fields:array<string>,reason:string,at:bigint>>"
PARSED = pa.list_(pa.struct([("start", pa.int64()), ("fields", pa.list_(pa.string())), ("reason", pa.string()), ("at", pa.int64())]))


def parse_lines(df: DataFrame, text: str, key: str, anchor: str, width: int | None = None) -> DataFrame:
    """(key, records): the records read from ``text``, each with start, fields, reason and at (null reason: well formed)."""
    grammar = Grammar(anchor, width=width)
    names = [f.name for f in PARSED.value_type]

    @F.arrow_udf(RECORDS)
    def read(lines: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [dict(zip(names, r, strict=True)) for r in grammar.blob(x)] for x in lines.to_pylist()], PARSED)

    line = F.coalesce(F.col(text), F.lit(""))
    body = F.regexp_replace(line, r"[\r\n]+\z", "")
    split = F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(body, grammar.sep))
    simple = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), split.alias("fields"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("bigint").alias("at")))
    rows = df.select(F.col(key).alias("key"), line.alias("line"), once(line.contains(grammar.quote) | body.contains("\n")).alias("hard"), simple.alias("simple"))
    return rows.select("key", once(F.coalesce(read(F.when(F.col("hard"), F.col("line"))), "simple")).alias("records"))


def trimmed(c: Column) -> Column:
    """Without white space at either end, Unicode spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def decimal_between(c: Column, low: float | None = None, high: float | None = None, above: float | None = None) -> Column:
    """A plain ASCII decimal within the bounds."""
    v = c.try_cast("double")
    ok = c.rlike(r"^-?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)$")
    if low is not None:
        ok = ok & (v >= low)
    if high is not None:
        ok = ok & (v <= high)
    if above is not None:
        ok = ok & (v > above)
    return F.coalesce(ok, F.lit(False))


EXPORT_FIELDS = ["fmdb_id", "peptide_sequence", "length_of_peptide", "food_matrix", "protein", "ph", "temperature", "mass", "ic50_raw", "crawled_on"]
EXPORT_ANCHOR = r"\"?FMDB\d+\"?,"


def _judged(fields: Column) -> tuple[Column, Column, dict[str, Column]]:
    """(column_count or null, name of the first invalid field or null, trimmed fields) of one record."""
    f = {n: trimmed(F.get(fields, F.lit(i))) for i, n in enumerate(EXPORT_FIELDS)}
    checks = {
        "fmdb_id": f["fmdb_id"].rlike(r"^FMDB[0-9]+$"),
        "length_of_peptide": f["length_of_peptide"].rlike(r"^[0-9]+$") & decimal_between(f["length_of_peptide"], 1, 60),
        "ph": (f["ph"] == "") | decimal_between(f["ph"], 0, 14),
        "temperature": (f["temperature"] == "") | decimal_between(f["temperature"], -20, 150),
        "mass": (f["mass"] == "") | decimal_between(f["mass"], above=0),
        "crawled_on": f["crawled_on"].rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(f["crawled_on"], "yyyy-MM-dd").isNotNull(),
    }
    bad = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()])
    whole = F.size(fields) == len(EXPORT_FIELDS)
    return F.when(~whole, "column_count"), F.when(whole, bad), f


def load_export(df: DataFrame, text: str = "raw_line", key: str = "line_id") -> DataFrame:
    """Every record of the headerless export with its typed fields, or with the reason why it was not loaded.

    Columns: key, start, the ten fields (typed; null in rejected rows), reason (quoting, column_count or
    invalid_value; null when loaded), at (fault position) and column (name of the first invalid field).
    """
    rows = parse_lines(df, text, key, EXPORT_ANCHOR, len(EXPORT_FIELDS)).select("key", F.explode("records").alias("r")).select("key", "r.*")
    width, bad, f = _judged(F.col("fields"))
    rows = rows.withColumn("column", once(bad))
    rows = rows.withColumn("reason", F.coalesce("reason", width, F.when(F.col("column").isNotNull(), "invalid_value")))
    kinds = {"length_of_peptide": "int", "ph": "double", "temperature": "double", "mass": "double"}
    ok = F.col("reason").isNull()
    typed = {
        n: F.when(ok, F.try_to_date(c, "yyyy-MM-dd") if n == "crawled_on" else c.try_cast(kinds[n]) if n in kinds else c).alias(n)
        for n, c in f.items()
    }
    return rows.select("key", "start", *typed.values(), "reason", "at", "column")


def line_verdicts(df: DataFrame, text: str = "raw_line", key: str = "line_id") -> DataFrame:
    """(key, reason) of the rows that are not exactly one loadable record; ``quoting`` outranks the rest.

    Several records in one row are a wrong column count of that row. Every row is judged alone, whatever its key.
    """
    rows = parse_lines(df, text, key, EXPORT_ANCHOR, len(EXPORT_FIELDS))
    width, bad, _ = _judged(F.get("records", F.lit(0))["fields"])
    reason = F.when(F.exists("records", lambda r: r["reason"].isNotNull()), "quoting").when(F.size("records") > 1, "column_count").otherwise(F.coalesce(width, F.when(bad.isNotNull(), "invalid_value")))
    return rows.select("key", once(reason).alias("reason")).where(F.col("reason").isNotNull())


def potency_readings(df: DataFrame, raw: str = "ic50_raw", key: str = "row_id") -> DataFrame:
    """Every potency text as loaded: (key, kind, value, upper, unit_text, reason, at).

    Missing texts, positive bare numbers, ranges, percentages and numbers with a unit of concentration are readable;
    the others have the reason ``invalid_value`` and the place of the fault in the plain form of the text: the unit
    if it is unknown, else the first number, else the beginning. ``value`` and ``upper`` are as written, null where
    no number is read.
    """
    spark = df.sparkSession
    units = F.broadcast(
        unit_table(spark).where(F.col("dimension").isin("molar", "mass")).select(F.col("alias").alias("q_alias"), F.lit(True).alias("is_unit"))
    )
    q = parse_potency(df.select(F.col(key).alias("key"), F.col(raw).alias("raw")), "raw").withColumn("q_alias", unit_key(F.col("q.unit_text")))
    q = q.join(units, "q_alias", "left")
    positive = F.coalesce(F.col("q.value") > 0, F.lit(False))
    known = F.coalesce(F.col("is_unit"), F.lit(False))
    kind = F.col("q.kind")
    readable = (
        (kind == "missing") | (kind.isin("bare", "percent") & positive) | ((kind == "single") & positive & known)
        | ((kind == "range") & (known | (F.col("q.unit_text") == "") | F.col("q.unit_text").startswith("%")) & positive & (F.col("q.upper") > 0))
    )
    text = plain(F.col("raw"))
    number = F.greatest(F.regexp_instr(text, F.lit("[0-9]")) - 1, F.lit(0))
    at = F.when(kind.isin("single", "range") & positive & ~known & (F.col("q.unit_text") != ""), F.greatest(F.instr(text, F.col("q.unit_text")) - 1, F.lit(0))).otherwise(number)
    return q.select(
        "key", kind.alias("kind"), F.col("q.value").alias("value"), F.col("q.upper").alias("upper"), F.col("q.unit_text").alias("unit_text"),
        F.when(~readable, "invalid_value").alias("reason"), F.when(~readable, at).alias("at"),
    )


def potency_verdicts(df: DataFrame, raw: str = "ic50_raw", key: str = "row_id") -> DataFrame:
    """(key, reason) of the rows whose potency text states no concentration; see :func:`potency_readings`."""
    return potency_readings(df, raw, key).where(F.col("reason").isNotNull()).select("key", "reason")
