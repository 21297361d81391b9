"""Held-out passages inside training texts, by winnowed fingerprints.

Texts become lower-case words (runs of letters and digits). Every word is hashed, every run of ``k`` words from the
hashes of its words; of each window of ``run - k + 1`` hashes the least is kept. Two texts that share ``run`` words
share a whole window, hence its least hash: no shared run of that length can be missed. Fingerprints of training and
test texts are joined by hash; the texts with a hit are read once more, and each hit is extended word by word around
its place until the run is long enough or breaks.

The fingerprints of the test items are broadcast only while their number is within a documented bound, beyond
it they meet the corpus by a salted shuffle. What moves is (key, hash, place); only texts with a hit are looked at
again. Hashing and winnowing run on the code-point arrays of Arrow batches, where they cost a fifth of what
expressions over word lists cost; everything else is built-in expressions. Linear in the length of a text.

Defined results: null, empty and blank texts, and texts of fewer than ``run`` words, leak nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylake.functions.plain import once
from assaylake.llm.plain_text import code_points
from assaylake.llm.tokens import LETTER, NUMBER, classes
from assaylake.session import cut_lineage

RUN, K = 12, 6
#: Test fingerprints up to which their table is broadcast (about 35 MB of hashes, keys and places).
BROADCAST_FINGERPRINTS = 500_000
SALTS = 8


# Letters and digits: of all scripts, and of the first 256 characters, which are looked up by a bit each.
ANY_WORD, LATIN_WORD = r"[\p{L}\p{N}]+", "[0-9A-Za-zªµºÀ-ÖØ-öø-ÿ²³¹¼-¾]+"


def words(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    latin = ~F.coalesce(text, F.lit("")).rlike("[^\\x00-ÿ]")
    return F.when(latin, F.regexp_extract_all(low, F.lit(LATIN_WORD), F.lit(0))).otherwise(F.regexp_extract_all(low, F.lit(ANY_WORD), F.lit(0)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd constant, modulo 2^64."""
    return np.multiply.accumulate(np.concatenate([[1], np.full(n - 1, 0x9E3779B97F4A7C15)]).astype(np.uint64))


def _over_windows(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` of every ``width`` neighbours, by spans that double."""
    span = 1
    while span < width:
        step = min(span, width - span)
        x, span = pick(x[:-step], x[step:]), span + step
    return x


def winnowed(texts: pa.Array, run: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, word) of every fingerprint of a batch of lower-case texts, all texts at once."""
    cps, offsets = code_points(texts)
    none = np.zeros(0, np.int64)
    if not len(cps):
        return none, none, none
    kind = classes()[cps]
    inside = (kind == LETTER) | (kind == NUMBER)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return none, none, none
    chars = np.flatnonzero(inside)
    word = np.cumsum(begins)[chars] - 1
    place = chars - starts[word]
    powers = _powers(1 << int(place.max() + 1).bit_length())
    hashed = _mixed(np.add.reduceat(_mixed(cps[chars].astype(np.uint64) + np.uint64(1)) * powers[place], np.searchsorted(chars, starts)))
    row = np.searchsorted(offsets, starts, side="right") - 1
    n, window = len(hashed), run - k + 1
    if n < run:
        return none, none, none
    grams = hashed[: n - k + 1] * np.uint64(1)
    for j in range(1, k):
        grams = _mixed(grams + hashed[j : n - k + 1 + j])
    whole = row[: n - run + 1] == row[run - 1 :]  # windows within one text
    least = np.where(whole, _over_windows(grams, window, np.minimum), np.uint64(0))
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    # The greatest least of the windows around a place is its own hash exactly where it is the least of one of them.
    kept = np.flatnonzero((_over_windows(padded, window, np.maximum) == grams) & (grams > 0))
    of_row = row[kept]
    return of_row, grams[kept].view(np.int64), kept - np.searchsorted(row, of_row)


def fingerprints(df: DataFrame, key: str, text: str, run: int = RUN, k: int = K) -> DataFrame:
    """(key, h, i): the hashes that winnowing keeps, and the word at which each begins, from 0.

    ``key`` keeps its values under that very name, whatever the table calls it. Where a hash is the least of a window
    more than once all its places are kept.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, h, i = winnowed(b.column(1), run, k)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(h), pa.array(i)], names=["key", "h", "i"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("h", T.LongType()), T.StructField("i", T.LongType())])
    return df.select(F.col(key).alias("key"), F.lower(text).alias("t")).mapInArrow(read, schema)


def leaks(corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int = RUN, k: int = K) -> DataFrame:
    """(key, item_key) of every text that shares ``run`` consecutive words with an item; distinct.

    Where both tables call their key the same, the item's is prefixed with ``item_``.
    """
    test = fingerprints(items, item_key, item_text, run, k).select(F.col("key").alias("ikey"), "h", F.col("i").alias("at_item"))
    mine = fingerprints(corpus, key, text, run, k)
    if test.limit(BROADCAST_FINGERPRINTS + 1).count() <= BROADCAST_FINGERPRINTS:
        hits = mine.join(F.broadcast(test), "h")
    else:
        test = test.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = mine.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(test, ["h", "salt"])
    # One row per pair, so that its words are looked at once however often they meet.
    hits = hits.groupBy("key", "ikey").agg(F.collect_set(F.struct("i", "at_item")).alias("seeds"))
    hits = cut_lineage(hits)  # read for the texts and for the items
    docs = _words_of(corpus, key, text, hits.select(F.col("key").alias("k")).distinct(), "w")
    its = _words_of(items, item_key, item_text, hits.select(F.col("ikey").alias("k")).distinct(), "iw").withColumnRenamed("k", "ik")
    both = hits.join(its, hits["ikey"].eqNullSafe(its["ik"])).join(docs, hits["key"].eqNullSafe(docs["k"]))
    found = both.where(F.exists("seeds", lambda s: _extends(s, run, k))).select("key", "ikey").distinct()
    return found.select(F.col("key").alias(key), F.col("ikey").alias(item_key if item_key != key else f"item_{item_key}"))


def _words_of(df: DataFrame, key: str, text: str, wanted: DataFrame, name: str) -> DataFrame:
    """(k, name): the words of the texts whose key is wanted."""
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    return rows.join(wanted, rows["_k"].eqNullSafe(wanted["k"])).select("k", once(words(F.col("_t"))).alias(name))


def _extends(seed: Column, run: int, k: int) -> Column:
    """The ``run`` words that start some words before the seed are the same in both texts."""
    def same(j: int) -> Column:
        a, b = (seed["i"] - j).cast("int"), (seed["at_item"] - j).cast("int")
        fits = (a >= 0) & (b >= 0) & (a + run <= F.size("w")) & (b + run <= F.size("iw"))
        return fits & reduce(lambda x, y: x & y, [F.get("w", a + x) == F.get("iw", b + x) for x in range(run)])

    return reduce(lambda x, y: x | y, [F.coalesce(same(j), F.lit(False)) for j in range(run - k + 1)])
