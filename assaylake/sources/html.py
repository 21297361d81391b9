"""HTML pages as columns: tables, links, key-value pairs, page class, and a crawl over stored pages.

Only the parsing of markup runs in Python, on Arrow batches; everything after it is built-in expressions.
"""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.functions.text import canonical_url
from assaylake.session import Rounds, cut_lineage

TABLES = T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))
LINKS = T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("label", T.StringType())]))


class _Tables(HTMLParser):
    """Cells of all tables in document order; nested tables follow their parents."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None
        self.links: list[tuple[str, str]] = []
        self.href: str | None = None
        self.label: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
            self.tables.append(self.open[-1])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]:
                self.open[-1].append([])
            self.cell = []
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")
        elif tag == "a":
            self.href, self.label = dict(attrs).get("href"), []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None and self.open and self.open[-1]:
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.open:
            self.open.pop()
        elif tag == "a" and self.href:
            self.links.append((self.href, " ".join("".join(self.label).split())))
            self.href = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)
        if self.href is not None:
            self.label.append(data)


def _parsed(text: str | None) -> _Tables:
    p = _Tables()
    if text:
        p.feed(text)
        p.close()
    return p


@F.pandas_udf(TABLES)
def tables_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [[row for row in table if row] for table in _parsed(t).tables])


@F.pandas_udf(LINKS)
def links_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"href": h, "label": s} for h, s in _parsed(t).links])


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def best_table(tables: Column, words: list[str]) -> Column:
    """The table whose first row names most of the words; the first of equals, null if none names any."""
    score = F.transform(tables, lambda t: F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(F.array_join(F.get(t, F.lit(0)), " ")), w))))
    top = F.array_max(score)
    return F.when(top > 0, F.get(tables, (F.array_position(score, top) - 1).cast("int")))


def table_rows(df: DataFrame, key: str, text: str, header: list[str]) -> DataFrame:
    """One row per data row of the best table, cells by header name; the first data row keeps position 1."""
    t = df.select(key, best_table(tables_of(F.col(text)), [h.lower() for h in header]).alias("t")).where("t is not null")
    t = t.select(key, F.transform(F.get("t", F.lit(0)), lambda h: F.lower(h)).alias("head"), F.posexplode("t").alias("row_no", "cells")).where("row_no > 0")
    return t.select(key, "row_no", *[F.get("cells", (F.array_position("head", h.lower()) - 1).cast("int")).alias(h) for h in header])


def pairs_of(tables: Column) -> Column:
    """Label -> value of all two-cell rows, labels without a trailing colon; the first of repeated labels."""
    rows = F.filter(F.flatten(tables), lambda r: F.size(r) == 2)
    entries = F.transform(rows, lambda r: F.struct(F.regexp_replace(F.trim(F.get(r, F.lit(0))), r"\s*:$", "").alias("k"), F.get(r, F.lit(1)).alias("v")))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.when(F.map_contains_key(m, e["k"]) | e["k"].isNull(), m).otherwise(F.map_concat(m, F.create_map(e["k"], e["v"]))))


def crawl(pages: DataFrame, seeds: list[str] | DataFrame, depth: int, host: str) -> DataFrame:
    """(url, depth) reachable from the seeds over the links of stored pages, breadth first within one host.

    Each round anti-joins the frontier with what was seen; the loop runs over depths, not over pages.
    """
    spark = pages.sparkSession
    links = pages.select(canonical_url(F.col("url")).alias("url"), F.explode(links_of(F.col("html"))).alias("l")).select("url", canonical_url(F.col("l.href")).alias("to"))
    links = cut_lineage(links.where(F.parse_url("to", F.lit("HOST")) == host).distinct())
    named = seeds if isinstance(seeds, DataFrame) else spark.createDataFrame([(s,) for s in seeds], "url string")
    seen = named.select(canonical_url(F.col(named.columns[0])).alias("url")).where("url is not null").distinct().withColumn("depth", F.lit(0))
    frontier, kept = seen, Rounds(spark)
    for d in range(1, depth + 1):
        step = frontier.join(links, "url").select(F.col("to").alias("url")).distinct().join(seen, "url", "left_anti")
        frontier = kept.keep(step.withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(frontier))
    return seen
