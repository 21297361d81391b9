"""Byte-level BPE ids of a whole corpus, without a regular expression.

A batch of texts becomes one array of code points (see plain_text). Look-up gathers give each its symbol; the
splitting rules are an automaton of eight states over these symbols, and the state before every character comes
from a prefix scan over the transition functions, whose monoid is built once as a composition table. The slices
go through a cache of merged pieces; a piece not yet seen is merged pair by pair by rank. Every id keeps the byte
at which it begins, so ids can be mapped back to the text, and ids are decoded by a gather of vocabulary bytes.

Defined results: a null text and an empty text have the empty list. Strings of special tokens are ordinary
text. The vocabulary's folder is a parameter; nothing is copied. No shuffle: rows stay where they are.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assaylake.llm.plain_text import code_points

TOKENIZER_DIR = "/opt/tokenizers"
OTHER, LETTER, NUMBER, SPACE, WHITE = 0, 1, 2, 3, 4
#: Pieces kept merged per worker; beyond it the cache starts anew.
CACHE_PIECES = 500_000
# The contractions that are tokens of their own.
SHORT_FORMS, LONG_FORMS = "stmd", ("re", "ve", "ll")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: letter, number, the space, other white space, other."""
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for run in regex.finditer(pattern, every):
            a, b = ord(run[0][0]), ord(run[0][-1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    table[ord(" ")] = SPACE
    return table


# Symbols of the splitting automaton: character classes, with the look-ahead that the rules need.
# SHORT letters end a contraction (``'s``); LONG ones begin one (``r`` before ``e``). White space is MIDDLE unless a
# word follows: then a last space joins the word (JOIN) and any other last white space is a piece alone (ALONE).
S_LETTER, S_SHORT, S_LONG, S_NUMBER, S_OTHER, S_QUOTE, S_MIDDLE, S_JOIN, S_ALONE = range(9)
SYMBOLS = 9
# States: what the characters read so far leave behind. CLOSED: a piece has ended; QUOTE: an apostrophe began a
# piece and may open a contraction; PENDING: the first letter of a two-letter contraction was read.
Q_CLOSED, Q_LETTER, Q_NUMBER, Q_OTHER, Q_WHITE, Q_JOIN, Q_QUOTE, Q_PENDING = range(8)
STATES = 8


def step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether the character starts a piece)."""
    if state == Q_PENDING:
        return Q_CLOSED, False
    if state == Q_QUOTE and symbol == S_SHORT:
        return Q_CLOSED, False
    if state == Q_QUOTE and symbol == S_LONG:
        return Q_PENDING, False
    if symbol in (S_LETTER, S_SHORT, S_LONG):
        return Q_LETTER, state not in (Q_LETTER, Q_JOIN)
    if symbol == S_NUMBER:
        return Q_NUMBER, state not in (Q_NUMBER, Q_JOIN)
    if symbol == S_QUOTE and state not in (Q_OTHER, Q_JOIN, Q_QUOTE):
        return Q_QUOTE, True
    if symbol in (S_OTHER, S_QUOTE):
        return Q_OTHER, state not in (Q_OTHER, Q_JOIN, Q_QUOTE)
    if symbol == S_MIDDLE:
        return Q_WHITE, state != Q_WHITE
    return (Q_JOIN if symbol == S_JOIN else Q_CLOSED), True


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(compose, after, constant, starts) of the monoid of transition functions.

    Functions are numbered; number ``s`` is the one of symbol ``s``, ``SYMBOLS + s`` the one of the symbol at the
    beginning of a text, which forgets what was before. ``compose[f, g]`` is f, then g; ``after[f, q]`` the state that
    f leads to from q; ``constant`` marks functions that lead to one state from everywhere; ``starts[q, s]`` tells
    whether symbol s starts a piece in state q.
    """
    moves = np.array([[step(q, s)[0] for q in range(STATES)] for s in range(SYMBOLS)])
    functions = [tuple(m) for m in moves] + [(m[Q_CLOSED],) * STATES for m in moves]
    number = {}
    for i, f in enumerate(functions):
        number.setdefault(f, i)
    for f in functions:  # grows while new products turn up
        for g in functions[: 2 * SYMBOLS]:
            product = tuple(g[q] for q in f)
            if product not in number:
                number[product] = len(functions)
                functions.append(product)
    after = np.array(functions, np.uint8)
    compose = np.array([[number[tuple(g[q] for q in f)] for g in functions] for f in functions], np.uint8)
    starts = np.array([[step(q, s)[1] for s in range(SYMBOLS)] for q in range(STATES)])
    return compose, after, (after == after[:, :1]).all(axis=1), starts


def symbols(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of every character; ``first`` marks the beginnings of texts."""
    kind = classes()[cps]
    table = np.array([S_OTHER, S_LETTER, S_NUMBER, S_MIDDLE, S_MIDDLE], np.uint8)
    out = table[kind]
    out[cps == ord("'")] = S_QUOTE
    following = np.zeros(len(cps), np.uint32)  # 0 where the text ends
    following[:-1] = cps[1:]
    following[:-1][first[1:]] = 0
    word_next = np.zeros(len(cps), bool)
    word_next[:-1] = (kind[1:] < SPACE) & ~first[1:]
    for c in SHORT_FORMS:
        out[cps == ord(c)] = S_SHORT
    for c, d in LONG_FORMS:
        out[(cps == ord(c)) & (following == ord(d))] = S_LONG
    out[(kind == SPACE) & word_next] = S_JOIN
    out[(kind == WHITE) & word_next] = S_ALONE
    return out


def piece_starts(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of every piece over all rows; rows always start a piece.

    A prefix scan over transition functions: composition is associative, so every character composes the span
    behind it with the span before that, spans doubling. A span that has become constant needs nothing before it,
    which two or three doublings reach everywhere, since a text's beginning and most characters forget the past.
    """
    n = len(cps)
    if not n:
        return np.array([], np.int64)
    first = np.zeros(n, bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    compose, after, constant, starts = automaton()
    symbol = symbols(cps, first)
    f = symbol + first.astype(np.uint8) * np.uint8(SYMBOLS)
    span, open_at = 1, np.flatnonzero(~constant[f])
    while len(open_at):
        f[open_at] = compose[f[open_at - span], f[open_at]]  # the right side is gathered before it is written
        open_at = open_at[~constant[f[open_at]]]
        span *= 2
    before = np.zeros(n, np.uint8)
    before[1:] = after[f[:-1], 0]
    before[first] = Q_CLOSED
    return np.flatnonzero(starts[before, symbol])


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank is merged until none is known."""
    known = rank.get(piece)
    if known is not None:
        return [known]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 64:
        return _merge_long(parts, rank)
    while len(parts) > 1:
        best, at = min(((rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [rank[p] for p in parts]


def _merge_long(parts: list[bytes], rank: dict[bytes, int]) -> list[int]:
    """The same for long pieces, by a heap over a linked list: n log n instead of n squared."""
    import heapq

    n = len(parts)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    live = list(parts)
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = nxt[i] if live[i] is not None else n
        if live[i] is None or j >= n or live[i] + live[j] != both:
            continue
        live[i], live[j] = both, None
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        for a in (prv[i], i):
            if a >= 0 and nxt[a] < n and (r := rank.get(live[a] + live[nxt[a]])) is not None:
                heapq.heappush(heap, (r, a, live[a] + live[nxt[a]]))
    return [rank[p] for p in live if p is not None]


class Encoder:
    """Encodes Arrow string arrays with one vocabulary and a bounded cache of merged pieces."""

    def __init__(self, vocabulary: str):
        self.path, self.rank = vocabulary, ranks(vocabulary)
        self.cache: dict[str, list[int]] = {}

    def pieces(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(pieces, start of each within all characters, number of the first piece of each row)."""
        cps, offsets = code_points(texts)
        starts = piece_starts(cps, offsets)
        text = cps.astype("<u4").tobytes().decode("utf-32-le")
        bounds = [*starts.tolist(), len(cps)]
        return [text[a:b] for a, b in zip(bounds, bounds[1:])], starts, np.searchsorted(starts, offsets)

    def encode(self, texts: pa.Array) -> pa.Array:
        """A list of int64 ids per text; null and empty texts have the empty list."""
        return self.encode_with_offsets(texts)[0]

    def encode_with_offsets(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(ids, offsets): the ids of each text, and the byte of its UTF-8 form at which each id begins."""
        pieces, _, row = self.pieces(texts)
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        cache, rank = self.cache, self.rank
        for p in set(pieces) - cache.keys():
            cache[p] = merge(p.encode("utf-8"), rank)
        ids = [cache[p] for p in pieces]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)), dtype=np.int64)])
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(ends[-1]))
        bounds = pa.array(ends[row], pa.int32())
        _, widths, _ = id_bytes(self.path)
        behind = np.concatenate([[0], np.cumsum(widths[flat], dtype=np.int64)])
        at = behind[:-1] - np.repeat(behind[ends[row[:-1]]], np.diff(ends[row]))
        return pa.ListArray.from_arrays(bounds, pa.array(flat)), pa.ListArray.from_arrays(bounds, pa.array(at))


@lru_cache(maxsize=4)
def id_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pool, width, place): all bytes of the vocabulary, and where the bytes of each id lie."""
    back = {i: token for token, i in ranks(path).items()}
    tokens = [back.get(i, b"") for i in range(max(back) + 1)]
    width = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.frombuffer(b"".join(tokens), np.uint8), width, np.cumsum(width) - width


def decode_array(ids: pa.Array, path: str) -> pa.Array:
    """The text of every list of ids, by one gather of vocabulary bytes; a null list is null."""
    pool, width, place = id_bytes(path)
    ids = ids.cast(pa.large_list(pa.int64()))
    bounds = ids.offsets.to_numpy().astype(np.int64)
    flat = ids.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]].astype(np.int64)
    w = width[flat]
    ends = np.concatenate([[0], np.cumsum(w, dtype=np.int64)])
    data = pool[np.repeat(place[flat] - ends[:-1], w) + np.arange(ends[-1])].tobytes()
    cuts = ends[bounds - bounds[0]]
    valid = np.asarray(ids.is_valid())
    # Ids cut inside a character leave broken bytes; such texts alone are read one by one.
    try:
        data.decode("utf-8")
        leads = np.frombuffer(data + b"a", np.uint8)[cuts]
        whole = not ((leads & 0xC0) == 0x80).any()
    except UnicodeDecodeError:
        whole = False
    if not whole:
        return pa.array([data[a:b].decode("utf-8", errors="replace") if v else None for a, b, v in zip(cuts, cuts[1:], valid)], pa.string())
    bits = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.large_string(), len(valid), [bits, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data)]).cast(pa.string())


@lru_cache(maxsize=4)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def encode(df: DataFrame, text: str, key: str, directory: str = TOKENIZER_DIR, name: str = "byte_bpe_50k", offsets: bool = False) -> DataFrame:
    """(key, ids) of every row; with ``offsets`` also the byte at which each id begins."""
    path = os.path.join(directory, f"{name}.tiktoken")
    names = [key, "ids", "offsets"] if offsets else [key, "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *enc.encode_with_offsets(b.column(1))][: len(names)], names=names)

    schema = T.StructType([df.schema[key], *[T.StructField(n, T.ArrayType(T.LongType())) for n in names[1:]]])
    return df.select(key, text).mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, key: str, directory: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, text) of every row: the empty list is the empty text, a null list a null."""
    path = os.path.join(directory, f"{name}.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), decode_array(b.column(1), path)], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, T.StructType([df.schema[key], T.StructField("text", T.StringType())]))
