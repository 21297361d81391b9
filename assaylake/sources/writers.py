"""Sinks: tables, single CSV files, append-unique manifests, summaries, charts and indexes.

Parquet is the primary form. Exports for people are one CSV file, which streams, and charts and summaries of tables
that are small by construction.
"""

from __future__ import annotations

import json
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame


# Flags in words, by truth.
YES_NO = {True: "是", False: "否"}


def write_table(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "errorifexists", partition_by: list[str] = ()) -> None:
    """Fixed column order, other columns dropped; never overwrites unless told to."""
    df = df.select(*columns) if columns else df
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def overwrite_with_backup(df: DataFrame, path: str) -> str | None:
    """Replaces a table on any file system; the old one is moved to ``.bak`` beside it once the new one is written."""
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    new, old, backup = jpath(f"{path}.new"), jpath(path), jpath(f"{path}.bak")
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(f"{path}.new")
    kept = None
    if fs.exists(old):
        fs.delete(backup, True)
        fs.rename(old, backup)
        kept = f"{path}.bak"
    fs.rename(new, old)
    return kept


def write_csv_file(df: DataFrame, path: str, columns: list[str] | None = None, headers: dict[str, str] | None = None, placeholder: dict | None = None, overwrite: bool = True, yes_no: list[str] = ()) -> int:
    """One CSV file with a byte-order mark; null is the empty text, an empty table may get a placeholder row.

    Rows come to the driver partition by partition, never all at once. ``headers`` renames columns, ``yes_no`` lists
    flags that are shown in words.
    """
    import csv

    if not overwrite and Path(path).exists():
        return 0
    columns = columns or df.columns
    Path(path).parent.mkdir(parents=True, exist_ok=True)

    def shown(c: str, v: object) -> object:
        return "" if v is None else YES_NO[bool(v)] if c in yes_no else v

    n = 0
    with Path(path).open("w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow([(headers or {}).get(c, c) for c in columns])
        for r in df.select(*columns).toLocalIterator():
            w.writerow([shown(c, r[c]) for c in columns])
            n += 1
        if not n and placeholder:
            w.writerow([shown(c, placeholder.get(c)) for c in columns])
            n = 1
    return n


def write_json(summary: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(summary, ensure_ascii=False, indent=2, default=str), encoding="utf-8")


def write_if_missing(text: str, path: str) -> bool:
    p = Path(path)
    if p.exists():
        return False
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text, encoding="utf-8")
    return True


def scaffold(root: str, folders: list[str], files: dict[str, str]) -> list[str]:
    """Folders and template files that are not there yet; returns what was made."""
    made = []
    for d in folders:
        if not (p := Path(root, d)).exists():
            p.mkdir(parents=True)
            made.append(d)
    return made + [f for f, text in files.items() if write_if_missing(text, str(Path(root, f)))]


def text_summary(df: DataFrame, n: int = 15) -> str:
    """The first rows as text, for a console."""
    return "\n".join(str(r.asDict()) for r in df.take(n))


def _svg(width: int, height: int, title: str, body: list[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12"><text x="16" y="24" font-size="16">{escape(title)}</text>'
    return head + "".join(body) + "</svg>"


def bar_chart(rows: list[tuple[str, float]], title: str, diverging: bool = False) -> str:
    """Horizontal bars, from a centre line where values have both signs."""
    top = max((abs(v) for _, v in rows), default=0) or 1
    zero, span = (360, 200) if diverging else (160, 400)
    body = []
    for i, (label, v) in enumerate(rows):
        w = abs(v) / top * span
        x, y = zero - w if v < 0 else zero, 44 + 22 * i
        body.append(f'<text x="150" y="{y + 12}" text-anchor="end">{escape(str(label))}</text><rect x="{x:.1f}" y="{y}" width="{w:.1f}" height="16" fill="{"#b5483a" if v < 0 else "#3a6fb5"}"/><text x="{max(x + w, zero) + 6:.1f}" y="{y + 12}">{v:g}</text>')
    return _svg(640, 60 + 22 * len(rows), title, body)


# Colours of the series of a grouped chart, in order.
SERIES_COLOURS = ["#3a6fb5", "#b5483a", "#4d9a5b", "#8a6bb0", "#c08a2e"]


def grouped_bar_chart(rows: list[tuple[str, list[float]]], series: list[str], title: str) -> str:
    """Groups of horizontal bars, one colour a series, with a legend."""
    top = max((abs(v) for _, vs in rows for v in vs), default=0) or 1
    body = [f'<rect x="{160 + 120 * i}" y="34" width="10" height="10" fill="{SERIES_COLOURS[i % len(SERIES_COLOURS)]}"/><text x="{174 + 120 * i}" y="43">{escape(s)}</text>' for i, s in enumerate(series)]
    y = 54
    for label, vs in rows:
        body.append(f'<text x="150" y="{y + 8 * len(vs)}" text-anchor="end">{escape(str(label))}</text>')
        for i, (_, v) in enumerate(zip(series, vs, strict=True)):
            w = abs(v) / top * 400
            body.append(f'<rect x="160" y="{y}" width="{w:.1f}" height="12" fill="{SERIES_COLOURS[i % len(SERIES_COLOURS)]}"/><text x="{166 + w:.1f}" y="{y + 10}">{v:g}</text>')
            y += 14
        y += 8
    return _svg(640, y + 10, title, body)


def heatmap(cells: dict[tuple[str, str], float], title: str) -> str:
    """Rows by columns; one hue for values of one sign, two for both."""
    ys, xs = sorted({a for a, _ in cells}), sorted({b for _, b in cells})
    top = max((abs(v) for v in cells.values()), default=0) or 1
    body = [f'<text x="{90 + 30 * i}" y="44">{escape(x)}</text>' for i, x in enumerate(xs)]
    for j, y in enumerate(ys):
        body.append(f'<text x="70" y="{66 + 24 * j}" text-anchor="end">{escape(y)}</text>')
        for i, x in enumerate(xs):
            v = cells.get((y, x), 0.0)
            body.append(f'<rect x="{80 + 30 * i}" y="{50 + 24 * j}" width="28" height="22" fill="{"#b5483a" if v < 0 else "#3a6fb5"}" fill-opacity="{abs(v) / top:.3f}"><title>{escape(f"{y} {x} {v:g}")}</title></rect>')
    return _svg(110 + 30 * len(xs), 70 + 24 * len(ys), title, body)


def scatter_chart(points: list[tuple[float, float, str]], title: str) -> str:
    top = max((max(abs(x), abs(y)) for x, y, _ in points), default=0) or 1
    body = ['<line x1="60" y1="440" x2="460" y2="40" stroke="#999"/>']
    body += [f'<circle cx="{60 + x / top * 400:.1f}" cy="{440 - y / top * 400:.1f}" r="3" fill="#3a6fb5"><title>{escape(label)}</title></circle>' for x, y, label in points]
    return _svg(500, 480, title, body)


def markdown_index(title: str, entries: list[tuple[str, str]]) -> str:
    return "\n".join([f"# {title}", "", *[f"- `{name}`: {what}" for name, what in entries], ""])
