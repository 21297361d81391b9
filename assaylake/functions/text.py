"""Cleaning of free text: missing tokens, white space, note lists, years, URLs.

Every function maps null to null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ten missing tokens, and the seven of the crawler's tables.
MISSING_TOKENS = ["", "na", "n/a", "nan", "none", "null", "-", "--", "nd", "n.d."]
CRAWL_MISSING_TOKENS = ["", "-", "--", "na", "n/a", "none", "null"]
# The twenty residues.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def normalize_spaces(c: Column) -> Column:
    """BOM, line breaks and runs of Unicode white space become one space; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "﻿", " "), r"(?U)\s+", " "))


def is_missing(c: Column, tokens: list[str] = MISSING_TOKENS) -> Column:
    """True for null, blank and the missing tokens in any case."""
    return c.isNull() | F.lower(normalize_spaces(c)).isin(tokens)


def clean_text(c: Column, tokens: list[str] = MISSING_TOKENS) -> Column:
    n = normalize_spaces(c)
    return F.when(~F.lower(n).isin(tokens), n)


def first_clean(*cols: Column) -> Column:
    """Coalesce over cleaned values."""
    return F.coalesce(*[clean_text(c) for c in cols])


def strip_bom(c: Column) -> Column:
    return F.regexp_replace(c, "^﻿+", "")


def clean_sequence(c: Column, drop_hyphen: bool = True) -> Column:
    """Upper case without inner spaces (and hyphens); missing tokens become null."""
    return F.regexp_replace(F.upper(clean_text(c)), r"[\s\-]+" if drop_hyphen else r"\s+", "")


def is_canonical(seq: Column) -> Column:
    return seq.rlike(f"^[{AMINO_ACIDS}]+$")


def set_join(values: Column) -> Column:
    """Sorted distinct non-null members joined by `` | ``; the empty set gives an empty text."""
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(values))), " | ")


def agg_set_join(c: Column) -> Column:
    """Aggregate form of :func:`set_join` over cleaned values."""
    return F.array_join(F.array_sort(F.collect_set(clean_text(c))), " | ")


def notes_of(c: Column) -> Column:
    """The trimmed non-empty tokens of a ``; `` list."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def has_note(c: Column, token: str) -> Column:
    return F.array_contains(notes_of(c), token)


def edit_notes(c: Column, add: list[Column | str] = (), remove: list[str] = ()) -> Column:
    """Drop resolved tokens, append new ones once, keep order; null additions are skipped."""
    kept = F.filter(notes_of(c), lambda x: ~x.isin(*remove)) if remove else notes_of(c)
    extra = F.array_compact(F.array(*[F.lit(a) if isinstance(a, str) else a for a in add])) if add else F.array().cast("array<string>")
    return F.array_join(F.array_distinct(F.concat(kept, extra)), "; ")


def _years(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda x: x.cast("int"))


def year_latest(c: Column) -> Column:
    return F.array_max(_years(c))


def year_earliest(title: Column, doi: Column) -> Column:
    """Earliest year of the title, else of the DOI."""
    return F.coalesce(F.array_min(_years(title)), F.array_min(_years(doi)))


def year_from_digits(c: Column) -> Column:
    """First four of all digits, if 1800 to 2100."""
    y = F.substring(F.regexp_replace(clean_text(c), r"\D", ""), 1, 4)
    v = F.when(F.length(y) == 4, y.cast("int"))
    return F.when(v.between(1800, 2100), v)


def section(text: Column, start: str, ends: list[str]) -> Column:
    """Text between a label and the nearest end label, cleaned."""
    import re

    stop = "|".join(re.escape(e) for e in ends)
    return clean_text(F.regexp_extract(text, rf"(?is){re.escape(start)}(.*?)(?:{stop}|$)" if stop else rf"(?is){re.escape(start)}(.*)$", 1))


def html_to_text(c: Column) -> Column:
    """Script and style bodies dropped, tags to spaces, the common entities written out."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</p>|</tr>|</div>|</li>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&micro;", "µ"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(ch))
    return normalize_spaces(t)


# The parts of a reference, as RFC 3986 gives them: scheme, authority, path, query.
URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def url_parts(url: Column) -> tuple[Column, Column, Column, Column]:
    """(scheme, host, path, query); parts that are not there are empty. Scheme and host in lower case."""
    u = F.trim(url)
    part = [F.regexp_extract(u, URL, i) for i in (1, 2, 3, 4)]
    return F.lower(part[0]), F.lower(part[1]), part[2], part[3]


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def query_pairs(query: Column) -> Column:
    """The decoded (k, v) pairs of a query, sorted by key and value; bare keys have an empty value."""
    parts = F.filter(F.split(query, "&"), lambda x: x != "")
    pairs = F.transform(parts, lambda x: F.named_struct(F.lit("k"), _decoded(F.substring_index(x, "=", 1)), F.lit("v"), _decoded(F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise(""))))
    return F.array_sort(pairs)


def canonical_url(url: Column) -> Column:
    """Lower scheme and host, single slashes in the path, decoded and sorted query, no fragment; relative ones stay relative."""
    scheme, host, path, query = url_parts(url)
    path = F.regexp_replace(F.regexp_replace(path, ";[^/]*$", ""), "/+", "/")
    path = F.when(path == "", "/").otherwise(path)
    path = F.when((host != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path)).otherwise(path)
    sorted_query = F.array_join(F.transform(query_pairs(query), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), path,
        F.when(sorted_query != "", F.concat(F.lit("?"), sorted_query)).otherwise(""),
    )


def slug(c: Column, width: int = 60) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.substring(s, 1, width)


def safe_name(url: Column, prefix: str = "page") -> Column:
    """File name of a page: prefix, at most sixty characters of the path, twelve digits of the URL's MD5."""
    path = F.replace(F.regexp_replace(url_parts(url)[2], "^/+|/+$", ""), F.lit("/"), F.lit("_"))
    path = F.left(F.regexp_replace(F.when(path == "", "root").otherwise(path), r"[^A-Za-z0-9._\-]+", "_"), F.lit(60))
    return F.concat(F.lit(f"{prefix}_"), path, F.lit("_"), F.substring(F.md5(url), 1, 12))


# Words and query keys that speak for a detail page and for a list page.
DETAIL_WORDS = ["detail", "peptide", "peptide sequence", "ic50", "assay", "matrix", "culture", "protein", "doi", "entry", "record"]
LIST_WORDS = ["search", "advance", "browse", "activity", "result", "results", "page=", "list", "table", "hydrolysis", "experiment"]
DETAIL_KEYS = ["id", "seqid", "pid", "detail"]
LIST_KEYS = ["page", "search", "act", "activity", "keyword", "type"]


def page_class(url: Column, title: Column, text: Column) -> Column:
    """detail_like, list_like or unknown: words in URL, title and the whole text, and two points for a telling query key."""
    blob = F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    keys = F.transform(query_pairs(url_parts(F.coalesce(url, F.lit("")))[3]), lambda p: p["k"])

    def score(words: list[str], named: list[str]) -> Column:
        return F.size(keyword_hits(blob, words)) + F.when(F.arrays_overlap(keys, F.array(*map(F.lit, named))), 2).otherwise(0)

    detail, listed = score(DETAIL_WORDS, DETAIL_KEYS), score(LIST_WORDS, LIST_KEYS)
    return F.when(detail > listed, "detail_like").when(listed > detail, "list_like").otherwise("unknown")


def keyword_hits(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


def bibliography(c: Column) -> Column:
    """Struct (authors, title, year, source_type) of a bibliography section; the year behind its label, else the last one."""
    label = r"(?i)Year\s+Source\s+"
    found = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    title = normalize_spaces(F.regexp_extract(c, r"(?i)Title\s+(.+?)\s+Year\s+Source\s+[0-9]{4}", 1))
    title = normalize_spaces(F.regexp_replace(title, r"\s+[A-Z][A-Za-z.\-]+.*?\([0-9]{4}\)\s*$", ""))  # journal, volume and pages
    years = F.regexp_extract_all(c, F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1))
    kind = normalize_spaces(F.regexp_extract(c, label + r"[0-9]{4}\s+([A-Za-z][A-Za-z \-/]+)$", 1))
    low = F.lower(c)
    by_word = F.coalesce(*[F.when(low.contains(w.lower()), F.lit(w)) for w in SOURCE_TYPES])
    return F.struct(
        normalize_spaces(found(r"(?i)Authors\s+(.+?)\s+Title\s+")).alias("authors"), F.nullif(title, F.lit("")).alias("title"),
        F.coalesce(found(label + "([0-9]{4})"), F.try_element_at(years, F.lit(-1))).alias("year"), F.coalesce(F.nullif(kind, F.lit("")), by_word).alias("source_type"),
    )


# Source types by word, in order.
SOURCE_TYPES = ["Journal", "Book", "Patent", "Database"]


def activity_cell(c: Column) -> Column:
    """Struct (value, measure) of a cell like ``29.00 IC50``; another cell is its own value without measure."""
    t = F.replace(F.replace(normalize_spaces(c), F.lit("IC 50"), F.lit("IC50")), F.lit("EC 50"), F.lit("EC50"))
    p = r"(?i)(-?[0-9]+(?:\.[0-9]+)?)\s*((?:IC|EC)50)\b"
    hit = t.rlike(p)
    return F.struct(F.when(hit, F.regexp_extract(t, p, 1)).otherwise(t).alias("value"), F.when(hit, F.upper(F.regexp_extract(t, p, 2))).otherwise("").alias("measure"))


# The fields of a detail report and the patterns that find them; blocks end at three asterisks.
REPORT_FIELDS = {
    "name": r"ID\s+[0-9]+\s+Name\s+(.*?)\s+sequence", "sequence": r"sequence\s+(.*?)\s+\*\s*\*\s*\*", "function_text": r"Function:\s*(.*?)\s*Number of residues",
    "number_of_residues": r"Number of residues\s*(.*?)\s*Activity code", "activity_code": r"Activity code\s*(.*?)\s*Activity\s*:", "activity_name": r"Activity\s*:\s*(.*?)\s*Chemical mass",
    "chemical_mass": r"Chemical mass\s*([0-9]+(?:\.[0-9]+)?)", "monoisotopic_mass": r"Monoisotopic mass\s*([0-9]+(?:\.[0-9]+)?)",
    "activity_measure_label": r"\b((?:IC|EC)50)\s*:\s*.*?\s*\*\s*\*\s*\*", "activity_value_text": r"\b(?:IC|EC)50\s*:\s*(.*?)\s*\*\s*\*\s*\*",
    "bibliographic_raw": r"Bibliographic data:\s*(.*?)\s*\*\s*\*\s*\*", "additional_information_raw": r"Additional information:\s*(.*?)\s*\*\s*\*\s*\*",
    "database_reference_raw": r"Database reference:\s*(.*)$",
}
BIBLIOGRAPHY_FIELDS = {
    "bibliographic_authors": r"Authors\s*(.*?)\s*Title", "bibliographic_title": r"Title\s*(.*?)\s*Year\s+Source", "bibliographic_year": r"Year\s+Source\s*([0-9]{4})",
    "bibliographic_source_type": r"Year\s+Source\s*[0-9]{4}\s+(.+)$",
}
INFORMATION_FIELDS = {"smiles": r"SMILES:\s*(.*?)\s*InChI=", "inchi": r"(InChI=[^\n]+)", "inchikey": r"InChIKey:\s*(.*?)\s*(?:Information concerning|$)"}


def report_fields(text: Column) -> dict[str, Column]:
    """Every field of a detail report by name; empty where it is not found."""
    def first(p: str, c: Column) -> Column:
        return normalize_spaces(F.regexp_extract(c, f"(?is){p}", 1))

    out = {n: first(p, text) for n, p in REPORT_FIELDS.items()}
    out["activity_measure_label"] = F.upper(out["activity_measure_label"])
    raw = {n: F.regexp_extract(text, f"(?is){REPORT_FIELDS[n]}", 1) for n in ("bibliographic_raw", "additional_information_raw")}
    out |= {n: first(p, normalize_spaces(raw["bibliographic_raw"])) for n, p in BIBLIOGRAPHY_FIELDS.items()}
    return out | {n: first(p, normalize_spaces(raw["additional_information_raw"])) for n, p in INFORMATION_FIELDS.items()}


# A row of the list in running text.
LIST_ROW = (
    r"(?i)^\s*(?<id>[0-9]+)\s+(?<name>.+?)\s+(?<seq>[A-Za-z0-9~\-*.]+)\s+(?<chemical>[0-9]+(?:\.[0-9]+)?)\s+(?<mono>[0-9]+(?:\.[0-9]+)?)\s+"
    r"(?<value>[0-9]+(?:\.[0-9]+)?)\s+(?<measure>(?:IC|EC)50)\b"
)
LIST_ROW_FIELDS = ["peptide_id", "name", "sequence", "chemical_mass", "monoisotopic_mass", "activity_value_raw", "measure_type_raw"]


def list_rows_of_text(text: Column) -> Column:
    """Array of structs, one per list row of a page in running text; what is no row is left out."""
    parts = F.split(F.regexp_replace(text, r"(?i)Peptide\s+Data", "Peptide Data"), r"\bPeptide Data\b")
    parts = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.trim(F.get(F.split(normalize_spaces(x), r"\b(?:First\b|Search:|Page\s+[0-9]+\s*/\s*[0-9]+)\b"), F.lit(0))))
    rows = F.filter(parts, lambda x: F.rlike(x, F.lit(LIST_ROW)))
    return F.transform(rows, lambda x: F.struct(*[F.trim(F.regexp_extract(x, LIST_ROW, i)).alias(n) for i, n in enumerate(LIST_ROW_FIELDS, 1)]))


def list_rows_of_html(markup: Column) -> Column:
    """The same from the marked rows of a page, with the link of each; rows of fewer than seven cells or without id are left out."""
    blocks = F.regexp_extract_all(markup, F.lit(r"(?is)<tr\s+class=['\"]info['\"][^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.filter(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1))), lambda c: F.size(c) >= 7)

    def row(c: Column) -> Column:
        plain = [html_to_text(F.get(c, F.lit(i))) for i in range(1, 7)]
        cell = activity_cell(plain[5])
        values = [plain[0].try_cast("bigint").cast("string"), *plain[1:5], cell["value"], cell["measure"]]
        link = F.regexp_extract(F.get(c, F.lit(0)), r"(?i)href=['\"]([^'\"]*zm_ID=[0-9]+[^'\"]*)['\"]", 1)
        return F.struct(*[v.alias(n) for n, v in zip(LIST_ROW_FIELDS, values, strict=True)], link.alias("detail_list_url"))

    return F.filter(F.transform(cells, row), lambda r: r["peptide_id"].isNotNull())


def total_pages(text: Column) -> Column:
    """The total of the last ``Page n / m`` of a text."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"Page\s+[0-9]+\s*/\s*([0-9]+)"), F.lit(1)), F.lit(-1)).try_cast("int")


# How a page states its number of entries, in order.
ENTRY_PATTERNS = [r"total number entries retrieved from this search are\s+([0-9]+)", r"total number of entries.*?([0-9]+)", r"entries retrieved.*?([0-9]+)"]


def total_entries(text: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(F.lower(text), p, 1), F.lit("")).try_cast("int") for p in ENTRY_PATTERNS])


def page_candidates(url: Column, page: Column) -> Column:
    """Canonical URLs under which the page behind number ``page`` may stand: page and offset keys, set or replaced; distinct."""
    scheme, host, path, query = url_parts(url)
    base = F.concat(scheme, F.lit("://"), host, path)

    def with_key(k: str, v: Column) -> Column:
        others = F.transform(F.filter(query_pairs(query), lambda p: p["k"] != k), lambda p: F.concat(p["k"], F.lit("="), p["v"]))
        return canonical_url(F.concat(base, F.lit("?"), F.array_join(F.concat(others, F.array(F.concat(F.lit(f"{k}="), v.cast("string")))), "&")))

    return F.array_distinct(F.array(*[with_key(k, page + 1) for k in ("page", "pageno", "Page", "PageNo")], *[with_key(k, page * 50) for k in ("start", "offset")]))
