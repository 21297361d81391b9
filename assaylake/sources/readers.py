"""Readers: raw text tables, delimited files of unknown encoding, detail texts, and fetched pages.

Schemas are checked on the driver before anything runs; contents are read distributed. ``ord`` is the line or
row position where a duplicate policy needs file order.
"""

from __future__ import annotations

import codecs
import csv
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.functions.text import clean_text, strip_bom

# Columns of the raw tab-separated activity tables.
RAW_COLUMNS = ["id", "seq", "len", "molwt", "ic50", "source", "mice", "method", "assay", "bitter", "pi", "bp"]
ENCODINGS = ["utf-8-sig", "utf-8", "gb18030", "latin1"]
BLOCK_BYTES = 1 << 20


class SchemaError(ValueError):
    """Columns are missing, or rows have a wrong number of fields."""


def raw_fields(line: Column) -> Column:
    """Split at tabs if there is one, else at two or more white spaces."""
    return F.when(line.contains("\t"), F.split(line, "\t")).otherwise(F.split(F.trim(line), r"\s{2,}"))


def read_raw_table(spark: SparkSession, path: str, table_from: str, columns: list[str] = RAW_COLUMNS) -> DataFrame:
    """Raw text table with an exact header; blank lines dropped, a row of another width fails the job."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    header = [x.strip() for x in lines.select(raw_fields(strip_bom(F.col("value"))).alias("h")).first()["h"]]
    if header != columns:
        raise SchemaError(f"header {header} is not {columns}")
    f = raw_fields(strip_bom(F.col("value")))
    rows = lines.select(f.alias("f"), F.col("_metadata.file_name").alias("file_name"), F.monotonically_increasing_id().alias("ord"))
    rows = rows.where(F.col("f") != F.array(*[F.lit(c) for c in columns]))
    width = F.when(F.size("f") == len(columns), F.col("f")).otherwise(F.raise_error(F.concat(F.lit("row of another width: "), F.array_join("f", "|"))))
    return rows.select(width.alias("f"), "ord").select(*[F.trim(F.get("f", i)).alias(c) for i, c in enumerate(columns)], F.lit(table_from).alias("table_from"), "ord")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {missing}")
    return df


def read_csv(spark: SparkSession, path: str, required: list[str] = (), sep: str = ",", encoding: str = "UTF-8", clean: bool = False, multiline: bool = True) -> DataFrame:
    """Header CSV; all columns are text, byte-order marks stripped from the header.

    Values may hold quoted line breaks, which makes a file one task; ``multiline=False`` splits large files of which
    it is known that they hold none.
    """
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, multiLine=multiline, quote='"', escape='"', inferSchema=False)
    df = require(df.toDF(*[c.lstrip("﻿").strip() for c in df.columns]), list(required))
    return df.select(*[clean_text(F.col(f"`{c}`")).alias(c) for c in df.columns]) if clean else df


def read_tsv(spark: SparkSession, path: str, required: list[str] = (), banner: str = "#Advanced search") -> DataFrame:
    """TSV export; rows without any value and banner rows are dropped."""
    df = read_csv(spark, path, required, sep="\t")
    first = F.col(f"`{df.columns[0]}`")
    empty = F.coalesce(*[F.when(F.trim(F.col(f"`{c}`")) != "", F.lit(1)) for c in df.columns]).isNull()
    return df.where(~empty & ~F.coalesce(first.startswith(banner), F.lit(False)))


def decodes(path: str, encoding: str) -> bool:
    """Whether the whole file, read in blocks, is valid in the encoding."""
    decoder = codecs.getincrementaldecoder(encoding)()
    with Path(path).open("rb") as f:
        try:
            while block := f.read(BLOCK_BYTES):
                decoder.decode(block)
            decoder.decode(b"", final=True)
        except UnicodeDecodeError:
            return False
    return True


def sniff(path: str) -> tuple[str, str]:
    """(encoding, separator) of a local file: the first encoding in which all of it is valid, and the separator of its first line."""
    for enc in ENCODINGS:
        if decodes(path, enc):
            with Path(path).open(encoding=enc) as f:
                line = f.readline(BLOCK_BYTES)
            return enc, max(",\t;", key=line.count)
    raise SchemaError(f"{path}: no known encoding")


def read_any_csv(spark: SparkSession, path: str, required: list[str] = ()) -> DataFrame:
    """CSV of unknown encoding and separator."""
    enc, sep = sniff(path)
    java = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "gb18030": "GB18030", "latin1": "ISO-8859-1"}[enc]
    if java == "GB18030":  # outside the default charsets; the session keeps the wider set, since reading is lazy
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return read_csv(spark, path, required, sep=sep, encoding=java)


def first_match(folder: str, patterns: list[str]) -> str:
    """The first file of the first pattern that matches."""
    for p in patterns:
        found = sorted(Path(folder).glob(p))
        if found:
            return str(found[0])
    raise FileNotFoundError(f"{folder}: none of {patterns}")


def _decode_first(body: bytes) -> str:
    """In the first encoding that fits."""
    for enc in ENCODINGS:
        try:
            return bytes(body).decode(enc)
        except UnicodeDecodeError:
            continue
    return bytes(body).decode("utf-8", errors="replace")


def read_detail_texts(spark: SparkSession, folder: str, pattern: str = r"detail_report_(\d+)\.txt$") -> DataFrame:
    """(peptide_id, path, text) of whole detail files, keyed by the id in the file name."""
    files = spark.read.format("binaryFile").load(folder)

    def decoded(content: pd.Series) -> pd.Series:
        return content.map(_decode_first)

    text = F.pandas_udf(decoded, T.StringType())(F.col("content"))
    return files.select(F.regexp_extract("path", pattern, 1).alias("peptide_id"), "path", text.alias("text")).where("peptide_id <> ''")


def with_detail_text(rows: DataFrame, texts: DataFrame, key: str = "peptide_id", path: str = "raw_text_path") -> DataFrame:
    """Left join by file name of the given path, else by id."""
    name = F.regexp_extract(F.regexp_replace(F.col(path), r"\\", "/"), r"detail_report_(\d+)\.txt$", 1)
    return rows.withColumn("_id", F.coalesce(F.nullif(name, F.lit("")), F.col(key))).join(texts.select(F.col("peptide_id").alias("_id"), F.col("text").alias("detail_text")), "_id", "left").drop("_id")


def _fetch_bytes(url: str, opener: Callable | None, timeout: float, tries: int, wait: float, backoff: float) -> tuple[dict, bytes | None, str | None]:
    """(record, body, charset) of one address; errors are values, never raised."""
    opener = opener or (lambda u: urllib.request.urlopen(u, timeout=timeout))
    began, last = time.monotonic(), None
    for attempt in range(tries):
        try:
            with opener(url) as r:
                body = r.read()
                charset = r.headers.get_content_charset() if hasattr(r.headers, "get_content_charset") else None
                return {"url": url, "ok": True, "status": getattr(r, "status", 200), "error_type": None, "elapsed": time.monotonic() - began, "tries": attempt + 1}, body, charset
        except (urllib.error.URLError, OSError, ValueError) as e:
            last = e
            if attempt + 1 < tries:
                time.sleep(wait * backoff**attempt)
    return {"url": url, "ok": False, "status": getattr(last, "code", None), "error_type": type(last).__name__, "elapsed": time.monotonic() - began, "tries": tries}, None, None


def fetch(url: str, opener: Callable | None = None, timeout: float = 20, tries: int = 3, wait: float = 1.0, backoff: float = 1.8) -> dict:
    """One page with charset decoding, retries and a structured record."""
    record, body, charset = _fetch_bytes(url, opener, timeout, tries, wait, backoff)
    return record | {"text": None if body is None else _decode(body, charset)}


def _decode(body: bytes, charset: str | None) -> str:
    for enc in [charset, *ENCODINGS]:
        try:
            return body.decode(enc) if enc else body.decode("utf-8")
        except (LookupError, UnicodeDecodeError):
            continue
    return body.decode("utf-8", errors="replace")


def download(url: str, to: str, opener: Callable | None = None, timeout: float = 30, tries: int = 4, wait: float = 3.0, backoff: float = 1.8) -> dict:
    """The bytes of an address to a file, skipped where it exists; written under another name first."""
    target = Path(to)
    if target.exists():
        return {"url": url, "ok": True, "status": "exists", "path": to}
    record, body, _ = _fetch_bytes(url, opener, timeout, tries, wait, backoff)
    if body is not None:
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_suffix(target.suffix + ".part")
        part.write_bytes(body)
        part.rename(target)
    return record | {"path": to}


def parse_args_paths(given: str | None, configured: str | None, default: str) -> str:
    """Path precedence: the command line, then the configuration, then the default."""
    return next(p for p in (given, configured, default) if p)


def convert_text_to_csv(path: str, out: str) -> str:
    """A raw text table as CSV: cells trimmed, blank lines dropped; existing and missing files are only reported."""
    if Path(out).exists():
        return "exists"
    if not Path(path).exists():
        return "missing"
    with Path(path).open(encoding="utf-8-sig", errors="replace") as src, Path(out).open("w", encoding="utf-8-sig", newline="") as dst:
        write = csv.writer(dst)
        for line in src:
            if line.strip():
                cells = line.rstrip("\n").split("\t") if "\t" in line else re.split(r"\s{2,}", line.strip())
                write.writerow([x.strip() for x in cells])
    return "converted"
