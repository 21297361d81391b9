"""Text problems: examples, edge rows, and brute force over whole small tables."""

import re
import sys
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from assaylake.functions.plain import char_map, plain
from assaylake.llm import leakage, plain_text, queries, representative, tokens, truncation
from conftest import SMALL
from pyspark.sql import functions as F

ODD = ["", None, "5 µM", "１２．５ μmol/㎖", "ȩ́ ça", "A​B C", "ΑΒС𝐐Ԛ", "10−10⁻³", "Å㎎ﬁ", "á́", "́x", "ж日本", "x" * 70000, "± × ≤ ≥ °C"]


def plain_by_row(s):
    if s is None:
        return None
    table = char_map()
    out = "".join(table.get(ord(c), c) for c in s)
    done = ""
    for c in out:
        joined = unicodedata.normalize("NFC", done[-1:] + c) if unicodedata.combining(c) else ""
        done = done[:-1] + joined if len(joined) == 1 and done else done + c
    return done


def test_plain_array_against_rows():
    got = plain_text.plain_array(pa.array(ODD + ODD[::-1])).to_pylist()
    assert got == [plain_by_row(s) for s in ODD + ODD[::-1]]
    assert got[2:5] == ["5 μM", "12.5 μmol/ml", "ȩ́ ça"] and got[6] == "ABCQQ" and got[7] == "10-10-3"
    assert plain_text.plain_array(pa.array([], pa.string())).to_pylist() == []
    assert plain_text.plain_array(pa.array(ODD).slice(2, 3)).to_pylist() == got[2:5]


def test_plain_sql_agrees_with_numpy(spark):
    rows = spark.read.parquet(f"{SMALL}/fermfoodb_ace_master_clean.parquet").select("ic50_raw", plain(F.col("ic50_raw")).alias("p")).collect()
    assert [plain_by_row(r[0]) for r in rows if r[0] and not re.search("[̀-ͯ]", r[0])] == [r[1] for r in rows if r[0] and not re.search("[̀-ͯ]", r[0])]


def test_plain_found_against_brute_force(spark):
    t = spark.read.parquet(f"{SMALL}/fermfoodb_ace_master_clean.parquet").select("row_id", "ic50_raw", "sequence").collect()
    missing = {"", "na", "n/a", "nan", "none", "null", "-", "--", "nd", "n.d."}
    want = {(r.row_id, c, plain_by_row(r[c])) for r in t for c in ("ic50_raw", "sequence") if r[c] is not None and r[c].strip().lower() not in missing and plain_by_row(r[c]) != r[c]}
    got = [tuple(r) for r in queries.p6_found(spark, SMALL).collect()]
    assert len(got) == len(want) and set(got) == want and len(want) > 100


TOKEN_TEXTS = [None, "", " ", "don't we'll 'tis it's's", "a  b\n\n c \t", "x'", "''s", " 's", "\n's", "9² ½ 中文abc", "<|endoftext|> hi", "!" * 90 + "a" * 200, "é" * 5 + "​", "😀😀 ok", "I'LL I'll"]


def test_tokens_against_library():
    tk = pytest.importorskip("tokenizers")
    lib = tk.Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    lib.encode_special_tokens = True
    rng = np.random.default_rng(0)
    alphabet = ["'", "s", "re", "ll", " ", "  ", "\n", "a", "Z", "é", "9", "!", "中", "'t", "　"]
    texts = TOKEN_TEXTS + ["".join(rng.choice(alphabet, 12)) for _ in range(3000)]
    vocabulary = f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
    got = tokens.encoder(vocabulary).encode(pa.array(texts)).to_pylist()
    assert got == [e.ids for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    ids, at = tokens.encoder(vocabulary).encode_with_offsets(pa.array(texts))
    assert tokens.decode_array(ids, vocabulary).to_pylist() == [t or "" for t in texts]
    widths = {i: len(b) for b, i in tokens.ranks(vocabulary).items()}
    assert all(a == [sum(widths[x] for x in i[:k]) for k in range(len(i))] for i, a in zip(ids.to_pylist(), at.to_pylist()) if len(i) < 50)
    part = ids.slice(3, 2)
    assert tokens.decode_array(part, vocabulary).to_pylist() == texts[3:5] and tokens.decode_array(pa.array([None, [220]], pa.list_(pa.int64())), vocabulary).to_pylist() == [None, " "]
    cut = pa.array([lib.encode("龘").ids[:1], lib.encode("a").ids])
    assert tokens.decode_array(cut, vocabulary).to_pylist() == ["�", "a"]
    assert tokens.encoder(vocabulary).encode(pa.array([], pa.string())).to_pylist() == []


def test_token_offsets_give_the_text_back():
    pieces, starts, row = tokens.encoder(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.tiktoken").pieces(pa.array(TOKEN_TEXTS))
    for i, t in enumerate(TOKEN_TEXTS):
        assert "".join(pieces[row[i] : row[i + 1]]) == (t or "")
    assert list(np.cumsum([0, *map(len, pieces)])[:-1]) == list(starts)


def test_transition_functions_compose_associatively():
    compose, after, constant, _ = tokens.automaton()
    n = len(compose)
    rng = np.random.default_rng(1)
    for f, g, h in rng.integers(0, n, (500, 3)):
        assert compose[compose[f, g], h] == compose[f, compose[g, h]] and (after[compose[f, g]] == after[g][after[f]]).all()
    text = "".join(rng.choice(list("'srevldt x\n1.")) for _ in range(5000))
    cps = np.array([ord(c) for c in text], np.uint32)
    first = np.zeros(len(cps), bool)
    first[0] = True
    state, starts = tokens.Q_CLOSED, []
    for i, s in enumerate(tokens.symbols(cps, first)):
        state, begins = tokens.step(state, int(s))
        starts += [i] if begins else []
    assert tokens.piece_starts(cps, np.array([0, len(cps)])).tolist() == starts and constant[tokens.SYMBOLS :][: tokens.SYMBOLS].all()


def test_ids_of_whole_table(spark):
    got = queries.p7_ids(spark, SMALL)
    assert got.count() == 1000 and got.where("ids is null").count() == 0
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id: r.text for r in queries.p7_decoded(spark, SMALL).collect()} == texts
    assert all(r.last_id_at <= len(texts[r.doc_id].encode()) and (r.n_ids > 0) == (texts[r.doc_id] != "") for r in queries.p7_offsets(spark, SMALL).collect())


def test_leaks_against_brute_force(spark):
    read = lambda t, k, x: [(r[k], re.findall(r"[^\W_]+", (r[x] or "").lower())) for r in spark.read.parquet(f"{SMALL}/{t}.parquet").collect()]
    grams = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    items = {}
    for k, w in read("eval_items", "item_id", "item_text"):
        for g in grams(w):
            items.setdefault(g, set()).add(k)
    want = {(d, k) for d, w in read("documents", "doc_id", "text") for g in grams(w) for k in items.get(g, ())}
    got = [tuple(r) for r in queries.p8_found(spark, SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10


def test_leaks_edges(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    docs = [(1, " ".join(words[5:17])), (2, " ".join(words[5:16])), (3, None), (4, ""), (5, "X, ".join(w.upper() for w in words[:13])), (6, ("w1 " * 50000) + " ".join(words))]
    items = [(7, "-".join(words)), (8, "w1 " * 30), (9, None)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    want = {(1, 7), (6, 7), (6, 8)}
    for bound in (leakage.BROADCAST_FINGERPRINTS, 0):
        monkeypatch.setattr(leakage, "BROADCAST_FINGERPRINTS", bound)
        assert {tuple(r) for r in leakage.leaks(df, "doc_id", "text", it, "item_id", "item_text").collect()} == want
    same = leakage.leaks(df.toDF("h", "w"), "h", "w", it.toDF("h", "near"), "h", "near")
    assert same.columns == ["h", "item_h"] and same.count() == 3
    assert leakage.leaks(df.limit(0), "doc_id", "text", it, "item_id", "item_text").count() == 0


SPELLED = {("AGK", 3): "AGK", ("a-g-k", 3): "AGK", ("H-Ala-Gly-Lys-OH", 3): "AGK", ("ALA-GLY-LYS", 3): "AGK", ("ALA", 3): "ALA", ("Ala", 1): "A", ("A​G​K ", 3): "AGK", ("H-A", 2): "HA", ("Gly Lys", None): "GK", ("HIS", None): "HIS", ("n.d.", 3): None, ("", None): None, (None, 2): None}


def test_residues(spark):
    df = spark.createDataFrame([(*k, v) for k, v in SPELLED.items()], "s string, n int, want string")
    for r in df.withColumn("got", representative.residues(F.col("s"), F.col("n"))).collect():
        assert r.got == r.want, r


def test_survivors_against_brute_force(spark):
    rows = queries._merged(spark, SMALL).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.merge_batch, r.peptide), []).append(r)
    missing = {"", "na", "n/a", "nan", "none", "null", "-", "--", "nd", "n.d."}
    order = lambda r: (-r.source_count, -r.merged_at.timestamp(), r.row_id)
    want = set()
    for g in groups.values():
        if len(g) > 1:
            ic = sorted((r for r in g if r.ic50_uM_median is not None and r.ic50_uM_median > 0), key=order)
            st = sorted((r for r in g if r.ic50_status_set is not None and r.ic50_status_set.strip().lower() not in missing), key=order)
            want.add((min(r.row_id for r in g), ic[0].row_id if ic else 0, st[0].row_id if st else 0))
    got = [tuple(r) for r in queries.p3_found(spark, SMALL).collect()]
    assert len(got) == len(want) and set(got) == want and len(want) > 50


def claim_table(spark, rows):
    """(g, field, value, source, best) rows as the claims that truth discovery reads."""
    c = spark.createDataFrame(rows, "g int, field string, value string, source string, best int")
    return c.groupBy("g", "field", "value").agg(F.array_sort(F.collect_set("source")).alias("side"), F.max("best").alias("best"))


@pytest.fixture(params=[representative.MAP_SOURCES, 0])
def map_sources(request, monkeypatch):
    """Both ways to keep reliabilities: a map, and a joined table."""
    monkeypatch.setattr(representative, "MAP_SOURCES", request.param)


def test_truth_discovery_trusts_the_agreeing_source(spark, map_sources):
    rows = [(g, "f", "right", s, g) for g in range(6) for s in ("a", "b")] + [(g, "f", "wrong", "c", g) for g in range(6)] + [(9, "f", "lone", "a", 9), (9, "f", "other", "c", 9)]
    c = claim_table(spark, rows)
    best, trust = representative.truth_discovery(c, ["g"])
    t = {r.source: r.trust for r in trust.collect()}
    assert t["a"] > t["c"]
    assert {r.value for r in best.collect()} == {"right", "lone"}
    assert representative.truth_discovery(c.limit(0), ["g"])[0].count() == 0


def test_precedence_enters_the_vote_and_support_decides(spark, map_sources):
    rows = [(g, "f", "many", s, 1) for g in range(4) for s in ("a", "b")] + [(g, "f", "first", "c", 2) for g in range(4)]
    c = claim_table(spark, rows)
    alone, led = (representative.truth_discovery(c, ["g"], lead=x)[0].collect() for x in (1.0, representative.outweighing(c)))
    assert {r.value for r in alone} == {"many"} and {r.value for r in led} == {"first"}
    assert all(r.best == 2 for r in led) and all(r.support > 1 for r in led)
    # A lead that the reliabilities can make up for leaves the choice to them.
    assert {r.value for r in representative.truth_discovery(c, ["g"], lead=1.5)[0].collect()} == {"many"}


def test_survivors_of_support_alone_differ(spark, monkeypatch):
    found = {tuple(r) for r in queries.p3_found(spark, SMALL).collect()}
    monkeypatch.setattr(representative, "outweighing", lambda c: 1.0)
    assert {tuple(r) for r in queries.p3_found(spark, SMALL).collect()} != found


def test_a_lead_that_nothing_makes_up_for_needs_no_rounds(spark, tmp_path, monkeypatch):
    import duckdb

    def unused(*_):
        raise AssertionError("rounds without effect")

    for stage in ("kinds", "_learn", "_learn_joined", "cut_lineage"):
        monkeypatch.setattr(representative, stage, unused)
    # Rows of no batch are a batch of their own.
    merged = spark.read.parquet(f"{SMALL}/{queries.MERGED}.parquet")
    merged.withColumn("merge_batch", F.when(F.col("merge_batch") % 2 == 0, F.col("merge_batch"))).write.parquet(str(tmp_path / f"{queries.MERGED}.parquet"))
    con = duckdb.connect()
    con.execute(f"create view {queries.MERGED} as select * from read_parquet('{tmp_path}/{queries.MERGED}.parquet/*.parquet')")
    want = con.execute(queries.oracle_sql()["p3_found"]).fetchall()
    assert sorted(tuple(r) for r in queries.p3_found(spark, str(tmp_path)).collect()) == sorted(want) and len(want) > 50


def test_survivors_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view {queries.MERGED} as select * from read_parquet('{SMALL}/{queries.MERGED}.parquet')")
    want = con.execute(queries.oracle_sql()["p3_survivors"])
    columns = [d[0] for d in want.description]
    want = want.fetchall()
    got = [tuple(r) for r in queries.p3_survivors(spark, SMALL).select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 100


def test_truncation_on_a_small_corpus(spark):
    whole = ["The culture was grown at 37 °C for 40 h. The rest stayed unassigned.", "The rest stayed unassigned. The culture was grown at 12 °C for 10 h.", "Name: peptide AG\nMass: 12 Da"]
    cut = ["The rest stayed unassigned. The culture was gro", "The rest stayed unassigned. The culture was grown at 5", "The culture was grown at 37 °C for 40 h. The rest [...]", "The rest stayed unassigned. The culture &am", "The culture was grown at 37 °C<br"]
    rows = [(i, whole[i % 3]) for i in range(900)] + [(1000 + i, t) for i, t in enumerate(cut)] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "a b"), (2004, "word " * 30000 + "end.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0] for r in truncation.truncated(df).collect()} == {1000 + i for i in range(len(cut))}
    assert truncation.truncated(df.limit(0)).count() == 0
    clash = df.withColumnsRenamed({"doc_id": "w", "text": "a"}).withColumn("salt", F.lit("x"))
    assert {r.w for r in truncation.truncated(clash, "w", "a").collect()} == {1000 + i for i in range(len(cut))}


def test_texts_cut_inside_long_markup_and_after_a_word_or_two(spark):
    whole = [f"The culture {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} grew well. Probes (p < 0.05, n = {i}) stayed cold." for i in range(100)]
    link = "https://example.org/" + "a" * 300
    cut = [f'See <a href="{link}', f"See <a href='{link}' title=\"some words more", "Kept <!-- a remark " + "x " * 200, "37 &" + "a" * 30, "37 &#1234567890123", "The cultu", "Pro"]
    fine = [f'See <a href="{link}">this</a>.', "Seen (p < 0.05) here.", "Kept at 4 < 5 in all cases", "Solved.", "Zebra", "a b"]
    rows = list(enumerate(whole + ["Probes were kept. " + w for w in whole] + fine)) + [(1000 + i, t) for i, t in enumerate(cut)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0] for r in truncation.truncated(df).collect()} == {1000 + i for i in range(len(cut))}


def test_words_of_latin_texts_are_those_of_any_text(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("text is not null").select("text")
    odd = spark.createDataFrame([("ÉTÉ 2,5²µg/ml AGK-ß co-op' x_1\x85\xa0y\r\nZ QK",), ("A",), ("ﬁ Ω",), ("\ue000a\ue001 b",)], "text string")
    both = docs.unionByName(odd).select("text", truncation.words(F.col("text")).alias("w"), truncation._classed(truncation._lined(F.col("text")), F.lit(False)).alias("any"))
    assert both.count() > 900 and both.where("w <> any").count() == 0


def test_copies_of_a_cut_text_do_not_make_its_end_natural(spark):
    whole = [f"Batch {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} was stored cold. The visiting group {'left' if i % 2 else 'stayed'} here." for i in range(100)]
    cut = "Batch zz was stored cold. The visiting"
    rows = [(i, t) for i, t in enumerate(whole)] + [(1000 + i, cut) for i in range(48)] + [(2000, cut.upper()), (2001, cut.replace(". ", ".\n") + " [...]")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0] for r in truncation.truncated(df).collect()} == {r[0] for r in rows if r[0] >= 1000}
    # Nor are whole texts cut that end alike in different words.
    alike = spark.createDataFrame([(i, t + " Kept by the visiting") for i, t in enumerate(whole)] + [(100 + i, t) for i, t in enumerate(whole)], "doc_id long, text string")
    assert truncation.truncated(alike).count() == 0


def test_residues_beside_han_characters_and_rare_ends(spark):
    residues = [a + b + c for a in "ACDEF" for b in "GHIK" for c in "LMNPQ"]
    han = [f"样品{i}。序列{r}与{r[::-1]}只差一个残基。" for i, r in enumerate(residues)]
    german = [f"Probe {a} mit kappa Casein blieb {b} ohne Wirkung." for a in ("roh", "warm", "kalt", "mild", "herb", "sauer") for b in ("lange", "kurz", "oft", "meist", "sonst", "immer", "weiter", "noch", "hier", "dort", "nun", "bald", "wieder", "selten", "stets", "heute", "kaum", "eben")]
    cut = ["样品一。序列FEW", "样品二。序列MCW与RVWFW只", "Nichts blieb anders. kappa"]
    rows = list(enumerate(han + german + ["Nichts blieb anders. unseren"])) + [(1000 + i, t) for i, t in enumerate(cut)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0] for r in truncation.truncated(df).collect()} == {1000, 1001, 1002}


def test_survivors_have_all_fields(spark):
    merged = spark.read.parquet(f"{SMALL}/{queries.MERGED}.parquet")
    got = queries.p3_survivors(spark, SMALL)
    kinds = dict(merged.dtypes)
    assert set(merged.columns) - {"row_id"} <= set(got.columns) and all(kinds[c] == k for c, k in got.dtypes if c in kinds)
    rows, groups = queries._merged(spark, SMALL).collect(), {}
    for r in rows:
        groups.setdefault((r.merge_batch, r.peptide), []).append(r)
    survivors = got.collect()
    assert len(survivors) == len(groups)
    for r in survivors:
        members = groups[(r.merge_batch, r.peptide)]
        for f in queries.SURVIVING:
            present = {m[f] for m in members if m[f] is not None and (f not in queries.SURVIVING_AMOUNTS or m[f] > 0) and (f not in queries.SURVIVING_TEXTS or m[f].strip().lower() not in queries.MISSING_TOKENS)}
            assert r[f] in present if present else r[f] is None, (f, r[f], present)


@pytest.mark.parametrize("lead", [1.0, 3.0])
def test_truth_discovery_settles_or_fails(spark, map_sources, lead):
    rows = [(g, "f", "right", s, g) for g in range(9) for s in ("a", "b")] + [(g, "f", "wrong", s, g + 1) for g in range(9) for s in "cd"[: 1 + g % 2]]
    rows += [(20, "f", x, s, b) for x, s, b in (("u", "a", 3), ("v", "b", 2), ("w", "c", 1))] + [(21, "f", x, s, b) for x, s, b in (("u", "c", 1), ("u", "d", 1), ("v", "a", 2))]
    c = claim_table(spark, rows)
    trust, moved, cells, best = dict.fromkeys("abcd", 0.8), 1, {}, {}
    for g, _, v, s, b in rows:
        cells.setdefault(g, {}).setdefault(v, []).append(s)
        best[g] = max(best.get(g, (0, "")), (b, v))
    while moved >= representative.TOLERANCE:
        shares = {s: [] for s in trust}
        for g, cell in cells.items():
            votes = {v: sum(trust[s] for s in side) * (lead if v == best[g][1] else 1) for v, side in cell.items()}
            for v, side in cell.items():
                for s in side:
                    shares[s].append(votes[v] / sum(votes.values()))
        new = {s: max(sum(x) / len(x), 0.01) for s, x in shares.items()}
        moved, trust = max(abs(new[s] - trust[s]) for s in trust), new
    got = {r.source: r.trust for r in representative.truth_discovery(c, ["g"], lead)[1].collect()}
    assert got == pytest.approx(trust, abs=1e-9)
    with pytest.raises(representative.NotConverged):
        representative.truth_discovery(c, ["g"], rounds=1)
