"""Texts that stop before their end, found by how texts of the corpus usually end.

Word trigrams are counted inside texts and at their ends. The final trigram of each text is joined with those
counts: one that is frequent inside but almost never ends a text marks a cut. Numbers, ids and residue strings
count as one word class each, CJK characters are words. A final word may itself be cut: it is a fragment where
nearly all inside trigrams behind the same two words continue it. Trigrams that often end a line inside texts
may end a text. Final trigrams too rare to judge fall back to the last two words, and these to the last one. Texts that stop inside markup, an entity or a broken character are cut
whatever the counts say; what is put after a cut (dots, "more") is taken off first. Two marks of the beginning
stand before every text, so that texts of one or two words have a final trigram too.

All counts are over distinct texts (case and white space folded), so that a text delivered again is no witness of
its own end, and the verdict of a text holds for all its deliveries. Only what is too rare among distinct texts
is judged by how many rows hold it inside; ends are never counted by rows.

Texts are reduced map-side before they move and split into words once, which are written in text form and read
twice; n-grams are reduced map-side. Tables of n-grams meet by equality only: a longer word meets the fragment
through its beginnings, of the lengths that fragments behind the same words have. The texts meet n-grams only
through their own final trigram, the rows through the hash of their text. Built-in expressions only.

Defined results: null, empty and blank texts are no cases. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.plain import once
from assaylake.session import cut_lineage

#: Share of an arbitrary trigram's occurrences at which texts are cut by chance; a final trigram with no more ends than
#: that (plus three deviations and one) is no natural end. Occurrences from which a trigram is judged.
CHANCE_SHARE, LEAST_SEEN = 0.0025, 8
#: The same for the last two words, used where the trigram is too rare, and for the last one where both are.
LEAST_PAIR_SHARE, LEAST_PAIRS = 0.002, 100
#: A last word is a fragment if its whole forms hold at least all but this share of the inside occurrences.
FRAGMENT_SHARE = 0.02
#: A trigram of which this share of the inside occurrences ends a line may end a text.
LINE_SHARE = 0.3
SALTS = 8

#: Marks of a line end and of the beginning of a text, private-use characters.
LINE, START = "\ue000", "\ue001"
# Marks that close a sentence.
STOPS = [".", "!", "?", "。", "！", "？"]
# What systems put after a cut, and how such a mark ends.
MARKERS = r"(?:\s*(?:\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)|…|\.{3})(?:\s*[\[(](?:more|continued|cont\.|truncated|cut)[\])])?|\s*[\[(](?:more|continued|truncated|cut)[\])])\s*$"
MARKER_ENDS = ["]", ")", "…"]
# A tag with attributes or a comment that is not closed, of any length; an entity without its semicolon; half a character.
INSIDE_MARKUP = r"(?:<[/!]?(?:[A-Za-z][A-Za-z0-9]*(?:\s+(?:[^\s<>]*|[^<>]*=[^<>]*))?)?|<!--[^>]*|&#?[A-Za-z0-9]*|�)$"
# White space of all scripts, written out: a property look-up for every character is slow.
NOT_SPACE_WHITE = r"\x09-\x0D\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACES, SHOWN = f"[ {NOT_SPACE_WHITE}]", f"[^ {NOT_SPACE_WHITE}]"
WHITE_CHARACTERS = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# White space that is not a single space between words already.
UNFOLDED = f"(?:[{NOT_SPACE_WHITE}]{SPACES}*| {SPACES}+)"


def _patterns(letters: str, written: str, numbers: str, small: str) -> dict[str, str]:
    """The word rules: ``letters`` is the class of letters that cannot touch a residue string, ``written`` that of words."""
    residue = "[ACDEFGHIKLMNPQRSTVWY]"
    return {
        "number": rf"{numbers}+(?:[.,]{numbers}+)*",
        "residues": rf"(?={residue})(?<!{letters}){residue}+(?!{letters})",  # the cheap test comes first
        "word": rf"(?:{written}+(?:[-'’_/]{written}+)*(?:[-/](?=\s|$))?|[^\s]){LINE}?", "small": small,
    }


# The same rules twice: over all of Unicode, and over the first 256 characters, which are looked up by a bit each.
# Letters are those of scripts that write words apart; numbers and residue strings are ``#`` and ``@`` by then.
ANY = _patterns(r"[\p{L}#&&[^\p{IsHan}]]", r"[\p{L}\p{M}#@&&[^\p{IsHan}]]", r"\p{N}", r"[\p{Ll}\p{IsHan}]")
LATIN = _patterns("[A-Za-zªµºÀ-ÖØ-öø-ÿ#]", "[A-Za-zªµºÀ-ÖØ-öø-ÿ#@]", "[0-9²³¹¼-¾]", "[a-zµß-öø-ÿ]")


def _classed(lined: Column, latin: Column, residues: bool = True) -> Column:
    """The words of ``lined`` (line ends marked), in classes: ``#`` for numbers, ``@`` for residue strings, lower case."""
    def by(p: dict[str, str]) -> Column:
        t = F.regexp_replace(lined, p["number"], "#")
        if residues:  # in a text all in capitals every word would look like residues, unless its words are in Han characters
            t = F.when(F.rlike(lined, F.lit(p["small"])), F.regexp_replace(t, p["residues"], "@")).otherwise(t)
        return F.regexp_extract_all(F.lower(t), F.lit(p["word"]), F.lit(0))

    return F.when(latin, by(LATIN)).otherwise(by(ANY))


def _lined(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, LINE + START, ""), r"\s*[\r\n]\s*", LINE + " ")


def words(text: Column) -> Column:
    """The words of a text; one before a line end carries the line mark."""
    return _classed(_lined(text), ~text.rlike("[^\\x00-ÿ]"))


def delivered(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h, t): every text that is not blank, without the marker of a cut, and the hash of its folded form."""
    white = F.lit(WHITE_CHARACTERS)
    rows = df.select(F.col(key).alias("key"), once(F.rtrim(text, white)).alias("t")).where("t <> ''")
    marked = F.right("t", F.lit(1)).isin(MARKER_ENDS) | F.endswith("t", F.lit("..."))
    bare = F.when(marked, F.rtrim(F.regexp_replace("t", MARKERS, ""), white)).otherwise(F.col("t"))
    rows = rows.select("key", once(bare).alias("t"))
    return rows.select("key", F.unhex(F.md5(F.lower(F.trim(F.regexp_replace("t", UNFOLDED, " "))))).alias("h"), "t")


def tokenised(rows: DataFrame) -> DataFrame:
    """(h, copies, markup, words, raw): the words of each distinct text, of its form with the most small letters first.

    ``words`` are joined by spaces, behind two marks of the beginning. ``raw`` is the last word outside the residue
    class, since the start of another word may look like residues.
    """
    texts = rows.groupBy("h").agg(F.max("t").alias("t"), F.count(F.lit(1)).alias("copies"))
    texts = texts.select("h", "copies", "t", once(F.struct(_lined(F.col("t")).alias("lined"), (~F.col("t").rlike("[^\\x00-ÿ]")).alias("latin"))).alias("x"))
    last = F.substring_index("x.lined", " ", -1)
    return texts.select(
        "h", "copies", F.col("t").rlike(INSIDE_MARKUP).alias("markup"), F.concat(F.lit(f"{START} {START} "), F.array_join(_classed(F.col("x.lined"), F.col("x.latin")), " ")).alias("words"),
        F.try_element_at(_classed(last, F.col("x.latin"), residues=False), F.lit(-1)).alias("raw"),
    )


def ngram_counts(tokens: DataFrame) -> DataFrame:
    """(a, b, c, inside, lines, ends, row_inside): distinct texts' occurrences of each trigram inside, of these at line
    ends, and at text ends; ``row_inside`` counts those inside once for every delivery."""
    rows = tokens.select("copies", once(F.struct(F.split("words", " ").alias("w"), F.split(F.replace("words", F.lit(LINE), F.lit("")), " ").alias("v"))).alias("x")).select("copies", "x.w", "x.v")
    n = F.size("w") - 2
    gram = F.arrays_zip(F.slice("v", 1, n).alias("a"), F.slice("v", 2, n).alias("b"), F.slice("v", 3, n).alias("c"), F.slice("w", 3, n).alias("raw"))
    g = rows.select(F.size("w").alias("n"), "copies", F.posexplode(gram).alias("i", "g"))
    g = g.select("g.a", "g.b", "g.c", "copies", F.endswith("g.raw", F.lit(LINE)).alias("line"), (F.col("i") == F.col("n") - 3).alias("end"))

    def count(c: Column) -> Column:
        return F.sum(c.cast("bigint"))

    inner = ~F.col("end")
    row_inside = F.sum(F.when(inner, F.col("copies")).otherwise(0)).alias("row_inside")
    return g.groupBy("a", "b", "c").agg(count(inner).alias("inside"), count(inner & F.col("line")).alias("lines"), count(F.col("end")).alias("ends"), row_inside)


def last_words(tokens: DataFrame) -> list[Column]:
    """The last three words, without line marks."""
    last = F.split(F.replace(F.substring_index("words", " ", -3), F.lit(LINE), F.lit("")), " ")
    return [F.get(last, i).alias(c) for i, c in enumerate("abc")]


def continued(left: DataFrame, right: DataFrame, on: list[str], inside: str, name: str) -> DataFrame:
    """The rows of ``left`` (on, c, ...) with the inside occurrences of longer last words behind the same words.

    A longer word meets its beginnings by equality. Only beginnings of the lengths that ``left`` has behind the same
    words are made, so a word of any length makes no more rows than there are such lengths, and counts are summed
    before they meet.
    """
    short = left.where(F.col("c").rlike(r"^[\p{L}#@][\p{L}#@\-/'’_]*$"))
    sizes = short.groupBy(*on).agg(F.collect_set(F.length("c")).alias("sizes"))
    long = right.where((F.length("c") > 1) & (F.col(inside) > 0)).select(*on, F.col("c").alias("longer"), F.col(inside).alias("n"))
    long = long.join(sizes, on).select(*on, "longer", "n", F.explode(F.filter("sizes", lambda k: k < F.length("longer"))).alias("k"))
    starts = long.groupBy(*on, F.left("longer", F.col("k")).alias("c")).agg(F.sum("n").alias(name))
    return short.join(starts, [*on, "c"])


def unnatural_ends(grams: DataFrame, residue_ends: DataFrame) -> DataFrame:
    """(a, b, c): final trigrams that are frequent inside texts but almost never end one.

    ``residue_ends`` (a, b, c) are ends in the residue class with the word itself as ``c``; they count as
    fragments where longer words, not residues, follow the same two words inside texts.
    """
    finals = grams.where("ends > 0")
    pairs = grams.groupBy("b", "c").agg(F.sum("inside").alias("inside2"), F.sum("ends").alias("ends2"), F.sum("row_inside").alias("row_inside2"))

    last = pairs.groupBy("c").agg(F.sum("inside2").alias("inside1"), F.sum("ends2").alias("ends1"))
    more3 = continued(finals.select("a", "b", "c"), grams, ["a", "b"], "inside", "more3")
    last_pairs = finals.select("b", "c").distinct().join(pairs, ["b", "c"])
    more2 = continued(last_pairs.select("b", "c"), pairs, ["b"], "inside2", "more2")
    f = finals.join(more3, ["a", "b", "c"], "left").join(last_pairs.join(more2, ["b", "c"], "left").join(last, "c"), ["b", "c"]).fillna(0, ["more3", "more2"])
    inside, ends, more3, more2 = F.col("inside"), F.col("ends"), F.col("more3"), F.col("more2")
    fragment = (more3 >= 2) & (inside <= FRAGMENT_SHARE * more3)

    def seldom_ends(held: Column) -> Column:
        by_chance = CHANCE_SHARE * (held + ends)
        return (held > 0) & (held + ends >= LEAST_SEEN) & (ends <= by_chance + 3 * F.sqrt(by_chance) + 1)

    def others_seldom_end(held: Column, n: str) -> Column:
        """Of the shorter last words; the text that is judged does not count itself."""
        return (held >= LEAST_PAIRS) & (F.col(n) - 1 < LEAST_PAIR_SHARE * held)

    rare, pair_rare = inside + ends < LEAST_SEEN, F.col("inside2") < LEAST_PAIRS
    judged = F.when(rare, seldom_ends(F.col("row_inside"))).otherwise(seldom_ends(inside))
    pair_fragment = (inside == 0) & (more2 >= LEAST_SEEN) & (F.col("inside2") <= FRAGMENT_SHARE * more2)
    pair_held = F.when(pair_rare, F.col("row_inside2")).otherwise(F.col("inside2"))
    pair_judged = others_seldom_end(pair_held, "ends2")
    word_judged = (pair_held < LEAST_PAIRS) & others_seldom_end(F.col("inside1"), "ends1")
    line = (F.col("lines") > 0) & (F.col("lines") >= LINE_SHARE * inside)
    stop = F.col("c").isin(*STOPS) & (F.col("b") != "#")  # a number before a stop may have been cut itself
    found = f.where(~line & ~stop & (fragment | judged | rare & (pair_fragment | pair_judged | word_judged))).select("a", "b", "c")
    real = grams.where("c = '@'").select("a", "b", F.col("inside").alias("real"))
    starts = continued(residue_ends, grams, ["a", "b"], "inside", "more3").join(real, ["a", "b"], "left")
    return found.unionByName(starts.where((more3 >= 2) & (F.coalesce("real", F.lit(0)) <= FRAGMENT_SHARE * more3)).select("a", "b", "c"))


def salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def salt_of(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")


def truncated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key) of the cut texts."""
    rows = delivered(df, key, text)
    tokens = cut_lineage(tokenised(rows))  # read twice: for the n-grams and for the ends
    grams = cut_lineage(ngram_counts(tokens))  # several readers below
    ends = tokens.select("h", "markup", *last_words(tokens), "raw")
    residue_ends = ends.where("c = '@'").select("a", "b", F.col("raw").alias("c")).distinct()
    bad = salted(unnatural_ends(grams, residue_ends).distinct())
    ends = ends.withColumn("salt", salt_of("h")).withColumn("c", F.explode(F.array_distinct(F.array("c", F.when(F.col("c") == "@", F.col("raw")).otherwise(F.col("c"))))))
    found = ends.join(bad.withColumn("cut", F.lit(True)), ["a", "b", "c", "salt"], "left")
    cut = salted(found.where(F.col("markup") | F.col("cut")).select("h").distinct())
    # One text may hold a large share of the rows.
    return rows.select("key", "h", salt_of("key").alias("salt")).join(cut, ["h", "salt"], "left_semi").select(F.col("key").alias(key)).distinct()


def rates(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How often each source truncates: texts, cut texts and their share."""
    cut = truncated(df, key, text).select(F.col(key).alias("key"), F.lit(1).alias("cut"))
    return (
        df.where(F.col(text).rlike(SHOWN)).select(F.col(key).alias("key"), source).join(cut, "key", "left").groupBy(source)
        .agg(F.count(F.lit(1)).alias("n_texts"), F.count("cut").alias("n_cut")).withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_texts"), 6))
    )
