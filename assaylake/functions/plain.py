"""The plain form of a text: ordinary characters for what a reader sees.

``char_map`` builds the whole table by rule from the Unicode database plus the fixed look-alike lists;
``plain`` applies it inside the JVM (``translate`` for one-to-one characters, ``replace`` for the few
composite unit signs) and is what parsers of this package read. Null stays null. Combining marks are
dropped here, since numbers and units carry none.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts that look like Latin ones, and the Latin letters they stand for.
CYRILLIC_LOOKALIKES = ("АВЕЅІЈКМНОРСТУХҮԚԜаеѕіјорсухһԛԝӏԁ", "ABESIJKMHOPCTYXYQWaesijopcyxhqwld")
GREEK_LOOKALIKES = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲ", "ABEZHIKMNOPTYXovc")
# Signs that look like ordinary punctuation.
SIGN_LOOKALIKES = (
    "‐‑‒–—―−˗⁄∕‘’‛′“”″∶∗∼˂˃‹›⩽⩾≦≧✕⨯˚º∣‚",
    "--------//''''\"\"\":*~<><>≤≥≤≥××°°|,",
)
MICRO = "μ"
#: Characters that show nothing: soft hyphen, joiners, direction marks, variation selectors and the like.
INVISIBLE = (
    [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x3164, 0xFEFF, 0xFFA0]
    + list(range(0x200B, 0x2010)) + list(range(0x202A, 0x202F)) + list(range(0x2060, 0x2070))
    + list(range(0xFE00, 0xFE10)) + list(range(0xE0000, 0xE0080)) + list(range(0xE0100, 0xE01F0))
)
#: Signs that stay as they are although a compatibility mapping exists or may come.
KEPT = set("±×≤≥°" + MICRO)


@lru_cache(maxsize=1)
def char_map() -> dict[int, str]:
    """Code point -> plain text, for every code point whose plain text differs."""
    table: dict[int, str] = {cp: "" for cp in INVISIBLE}
    for cp in (9, 10, 11, 12, 13, 0x85, 0x2028, 0x2029):
        table[cp] = " "
    looks = {a: b for src, dst in (CYRILLIC_LOOKALIKES, GREEK_LOOKALIKES, SIGN_LOOKALIKES) for a, b in zip(src, dst, strict=True)}
    for cp in (*range(0x80, 0xD800), *range(0xF900, 0xFFFE), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)):
        if cp in table:
            continue
        ch = chr(cp)
        if ch in KEPT:
            continue
        if ch in looks:
            table[cp] = looks[ch]
        elif unicodedata.category(ch) == "Zs":
            table[cp] = " "
        elif not unicodedata.combining(ch):
            folded = unicodedata.normalize("NFKC", ch)
            if folded[0] == " " or folded == ch and ch not in looks:  # free-standing accents stay
                continue
            table[cp] = "".join(looks.get(c, c) for c in folded)
    return table


@lru_cache(maxsize=1)
def _sql_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """translate() arguments, and the composite signs of the unit block written out."""
    one = {cp: to for cp, to in char_map().items() if len(to) == 1 and (to.isascii() or to in KEPT)}
    gone = [cp for cp, to in char_map().items() if to == "" and cp < 0xE0000] + list(range(0x300, 0x370))
    unit = re.compile(r"[pnmkdcμ]?(?:g|l|m|mol)|°[CF]|[ap]\.m\.|pH|cc|m/s")
    units = [(chr(cp), to) for cp, to in char_map().items() if 0x2100 <= cp <= 0x33DF and unit.fullmatch(to) and len(to) > 1]
    return "".join(map(chr, one)) + "".join(map(chr, gone)), "".join(one.values()), units


def once(value: Column) -> Column:
    """A generator of one row. Filters are not pushed below it, so what it holds is evaluated once a row."""
    return F.explode(F.array(value))


def plain(text: Column) -> Column:
    """Plain form for parsing; texts of ordinary characters only are passed through untouched."""
    src, dst, units = _sql_tables()
    # A composite sign is two or more characters; the chain runs on texts that hold one.
    out = text
    for sign, written in units:
        out = F.replace(out, F.lit(sign), F.lit(written))
    expanded = F.when(text.rlike("[℀-⅏㍱-㏟]"), out).otherwise(text)
    return F.when(text.rlike("[^ -~μ±×≤≥°]"), F.translate(expanded, src, dst)).otherwise(text)
