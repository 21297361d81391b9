"""Visually identical text in one form, on numpy code-point arrays.

An Arrow batch of texts becomes one array of code points. Look-up tables give each code point the length and
place of its plain form; gathers and cumulative offsets expand or drop characters; base letters and combining
marks are then composed by a sorted pair table. Python strings are touched once per batch, never per row.
The rows stay where they are: no shuffle.

Defined results: null stays null, the empty text stays empty, texts of any length are read whole. Tabs and
line ends show as spaces. Marks without a composed letter stay behind their base.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.functions.plain import char_map
from assaylake.functions.text import MISSING_TOKENS

SIZE = 0x110000


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length, start, pool, mark, pair keys, composed): the gather tables of the plain form."""
    length = np.ones(SIZE, np.uint8)
    start = np.arange(SIZE, dtype=np.int32)  # a code point's own place, until it has an expansion
    pool = [np.arange(SIZE, dtype=np.uint32)]
    at = SIZE
    for cp, text in char_map().items():
        length[cp], start[cp] = len(text), at
        pool.append(np.array([ord(c) for c in text], np.uint32))
        at += len(text)
    mark = np.zeros(SIZE, bool)
    pairs = {}
    for cp in range(0xC0, 0x2000):
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            a, b = (int(x, 16) for x in parts)
            if unicodedata.combining(chr(b)):
                mark[b] = True
                if unicodedata.normalize("NFC", chr(a) + chr(b)) == chr(cp):
                    pairs[(a << 21) | b] = cp
    keys = np.array(sorted(pairs), np.uint64)
    return length, start, np.concatenate(pool), mark, keys, np.array([pairs[int(k)] for k in keys], np.uint32)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string array, and the offset of each row (nulls are empty)."""
    texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else b""
    utf8 = np.frombuffer(raw, np.uint8)
    leads = np.concatenate([[0], np.cumsum((utf8 & 0xC0) != 0x80, dtype=np.int64)])
    cps = np.frombuffer(bytes(raw).decode("utf-8").encode("utf-32-le"), np.uint32)
    return cps, leads[offsets - offsets[0]]


def to_texts(cps: np.ndarray, offsets: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Inverse of :func:`code_points`."""
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    widths = 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])[offsets]
    bits = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(valid), [bits, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)]).cast(pa.string())


def _compose(cps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base and mark pairs of one row become one letter, until no pair is left."""
    _, _, _, mark, keys, composed = tables()
    while True:
        at = np.flatnonzero(mark[cps[1:]] & (row[1:] == row[:-1])) + 1 if len(cps) > 1 else np.array([], np.int64)
        if not len(at):
            return cps, row
        key = (cps[at - 1].astype(np.uint64) << np.uint64(21)) | cps[at].astype(np.uint64)
        where = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[where] == key
        hit[1:] &= ~(hit[:-1] & (at[1:] == at[:-1] + 1))  # a mark is taken by one base at a time
        if not hit.any():
            return cps, row
        cps = cps.copy()
        cps[at[hit] - 1] = composed[where[hit]]
        keep = np.ones(len(cps), bool)
        keep[at[hit]] = False
        cps, row = cps[keep], row[keep]


def plain_array(texts: pa.Array) -> pa.Array:
    """The plain form of every text of an Arrow string array."""
    length, start, pool, _, _, _ = tables()
    cps, offsets = code_points(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    n = length[cps].astype(np.int64)
    total = int(n.sum())
    ends = np.cumsum(n)
    place = np.repeat(start[cps] - (ends - n), n) + np.arange(total)
    cps, row = _compose(pool[place], np.repeat(row, n))
    counts = np.bincount(row, minlength=len(texts))
    return to_texts(cps, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), np.asarray(texts.is_valid()))


def with_plain(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with ``<c>_plain`` for each of the columns; all other columns are kept."""
    df = df.drop(*[f"{c}_plain" for c in columns])  # a column of that name is replaced
    order = [*df.columns, *[f"{c}_plain" for c in columns]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [plain_array(b.column(b.schema.get_field_index(c))) for c in columns]
            yield pa.RecordBatch.from_arrays([*b.columns, *found], names=order)

    schema = T.StructType([*df.schema.fields, *[T.StructField(f"{c}_plain", T.StringType()) for c in columns]])
    return df.mapInArrow(run, schema)


def differing(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field_name, plain_text) of the values that are neither missing nor in plain form."""
    rows = with_plain(df.select(key, *columns), columns)
    items = [
        F.when(~F.lower(F.trim(c)).isin(MISSING_TOKENS) & (F.col(c) != F.col(f"{c}_plain")), F.struct(F.lit(c).alias("field_name"), F.col(f"{c}_plain").alias("plain_text")))
        for c in columns
    ]
    return rows.select(key, F.explode(F.array_compact(F.array(*items))).alias("_i")).select(key, "_i.field_name", "_i.plain_text")
