"""Parsers, rules, features, relational kit, sources and sinks: vectors worked out by hand, and the SQL of all queries."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaylake.functions import features, ic50, numeric, rules
from assaylake.functions import text as tx
from assaylake.operators import classify
from assaylake.operators import relational as rel
from assaylake.plans import queries
from assaylake.sources import html, readers, writers
from conftest import SMALL


def read(spark, grammar, texts, mass=None):
    df = spark.createDataFrame([(i, t, mass) for i, t in enumerate(texts)], "i int, ic50_raw string, m double")
    return [r.p for r in ic50.with_reading(df, grammar, mass=F.col("m")).orderBy("i").collect()]


def test_ahtpdb_vectors(spark):
    cases = {
        "15.7 uM": ("exact", "=", 15.7, 15.7), "0.43 mM": ("exact", "=", 0.43, 430.0), "5 M": ("exact", "=", 5.0, 5e6), ">1500 uM": ("threshold", ">", 1500.0, 1500.0),
        "0.32-14 uM": ("range", None, None, None), "12 ug/ml": ("mass_unit", "=", 12.0, None), "45%": ("percent", None, 45.0, None), "11.6 μM/L": ("suspicious_unit", "=", 11.6, None),
        "26.2 26.2": ("dirty", None, 26.2, None), "26.2": ("dirty", None, None, None), "12 um": ("dirty", None, None, None), "1,200 uM": ("dirty", None, None, None), "n.d.": ("missing", None, None, None), "": ("missing", None, None, None), None: ("missing", None, None, None),
    }
    for (t, want), p in zip(cases.items(), read(spark, "AHTPDB", list(cases)), strict=True):
        assert (p.status, p.relation, p.value, p.um) == want, t


def test_biopep_vectors(spark):
    cases = {"29.00 [IC50]": ("numeric_no_unit", 29.0, None), "29.00 uM [IC50]": ("exact_molar", 29.0, 29.0), "<20 nM": ("molar_threshold", 20.0, 0.02), "0.5-1 uM": ("range", None, None), "1.2 mg/mL": ("mass_unit", 1.2, None), "30%": ("percent_like", 30.0, None), "about 12": ("ambiguous_text", 12.0, None), "high": ("unparsed_text", None, None)}
    for (t, want), p in zip(cases.items(), read(spark, "BIOPEP", list(cases)), strict=True):
        assert (p.status, p.value, p.um and round(p.um, 9)) == want, t


def test_fermfood_vectors(spark):
    cases = {"2.15±0.02 uM": 2.15, "300.1umol/l": 300.1, ">1000umol/l": 1000.0, "100 nM": 0.1, "1.2 mg/ml": 2000.0, "12": None, "5 M": None, "3 mg ml-1": None, "0.32-14 uM": -6.84, "IC50 = 5 uM": 27.5}
    for (t, want), p in zip(cases.items(), read(spark, "FermFooDb", list(cases), 600.0), strict=True):
        assert p.um == pytest.approx(want) if want is not None else p.um is None, t
    assert read(spark, "FermFooDb", ["1.2 mg/ml"])[0].status == "mass_concentration_needs_mass"
    assert [p.um for p in read(spark, "advanced", ["2+/-0.5 uM", "3 micromolar", "4 mcg/ml"], 500.0)] == [2.0, 3.0, 8.0]


def test_mbpdb_vectors(spark):
    got = read(spark, "MBPDB", ["52.8", "< 20", "1) 315.0, 2) 205.0, 3) 315.0", "315.0; 205.0", ""])
    assert [(p.status, p.um) for p in got] == [("exact_molar", 52.8), ("molar_threshold", 20.0), ("exact_molar", 315.0), ("exact_molar", 260.0), ("missing", None)]


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_rules(spark):
    L = F.lit
    none = L(None).cast("double")
    for args, want in (((1, 1, 1.0), "singleton"), ((2, 2, 10.0), "cross_source_consistent"), ((1, 3, 10.0), "within_range_consistent"), ((2, 2, 10.01), "conflicting"), ((2, 2, None), "unknown")):
        assert one(spark, rules.stability_flag(L(args[0]), L(args[1]), L(args[2]).cast("double"))) == want
    assert [one(spark, rules.stability_class(L(n), L(a), L(b))) for n, a, b in ((1, 5.0, 5.0), (2, 5.0, 15.0), (2, 5.0, 16.0), (2, 5.0, 50.1), (2, 0.0, 5.0), (0, 0.0, 0.0))] == ["stable", "stable", "condition-sensitive", "high-conflict", "undetermined", "undetermined"]
    assert [one(spark, rules.activity_tier(L(v))) for v in (50.0, 50.1, 200.0, 201.0)] == ["strong", "medium", "medium", "weak"]
    tiers = ((3, "within_range_consistent", 10.0, 1.0), (2, "cross_source_consistent", 2.0, 1.0), (1, "singleton", 1.0, 1.0), (2, "conflicting", 20.0, 1.0), (2, "unknown", None, 1.0))
    assert [one(spark, rules.consensus_tier(L(s), L(f), L(x).cast("double"), L(m))) for s, f, x, m in tiers] == ["Tier A", "Tier B", "Tier C", "Tier D", "Tier E"]
    scores = ((3, 4, "cross_source_consistent", 2.0, 108), (2, 2, "conflicting", 50.0, 12), (1, 1, "singleton", 1.0, 45))
    assert [one(spark, rules.consensus_score(L(s), L(r), L(f), L(x))) for s, r, f, x, _ in scores] == [w for *_, w in scores]
    assert one(spark, rules.priority(L("Tier_B"), L(1), L(2), L(2.0))) == 2128.0
    assert [one(spark, rules.conflict_severity(L(s), L(x).cast("double"))) for s, x in ((2, 100.0), (1, 100.0), (1, 10.0), (1, 9.9), (1, None))] == ["very_high", "high", "medium", "low", "unknown"]
    assert one(spark, rules.conflict_reason(L("unknown"), L(1), L(2), none)) == "spread_ratio_missing"
    assert [one(spark, rules.fold_bin(L(x).cast("double"))) for x in (1.0, 1.01, 1.5, 2.0, 2.5, 3.0, 3.1, 5.0, 10.0, 10.1, None)] == ["1", "(1,1.5]", "(1,1.5]", "(1.5,2]", "(2,3]", "(2,3]", "(3,5]", "(3,5]", "(5,10]", ">10", "missing"]
    assert [one(spark, rules.spread_bucket(L(x).cast("double"))) for x in (2.0, 2.1, 5.0, 10.0, 100.0, 100.1, None)] == ["le_2", "gt_2_le_5", "gt_2_le_5", "gt_5_le_10", "gt_10_le_100", "gt_100", "missing"]
    states = ((None, None, "missing_both"), (3, None, "sequence_only"), (None, 3, "detail_only"), (3, 3, "consistent"), (3, 4, "conflict"))
    assert [one(spark, rules.length_consistency(L(a).cast("int"), L(b).cast("int"))) for a, b, _ in states] == [w for *_, w in states]
    assert one(spark, rules.flag_note(L("Tier_A"), L("cross_source_consistent"), L(2), L(3), L(2.78125))) == "跨来源一致；source_count=2; record_count=3; spread_ratio=2.7812"
    assert one(spark, rules.flag_note(L("Tier_X"), L("unknown"), L(1), L(3), none)) == "存在冲突或状态未明；stability_flag=unknown; source_count=1; record_count=3"
    assert one(spark, rules.benchmark_note(L("Tier C"), none, L(1), L(45))) == "single-source usable IC50 candidate; spread_ratio=NA; source_count=1; score=45"


def test_numbers_and_text(spark):
    assert one(spark, numeric.mass_of_sequence(F.lit("AP"))) == pytest.approx(186.10043)
    assert one(spark, numeric.median_of(F.array(*[F.lit(float(v)) for v in (1, 2, 4, 10)]))) == 3.0
    assert [one(spark, numeric.to_float(F.lit(v))) for v in ("1,200.5", "0x1p3", "1.5d", "nan", "1e3")] == [1200.5, None, None, None, 1000.0]
    numbers = [1234567.8, 15.7, 0.000123456, 1.2345678e-5, 3.390625, 50.00005, 999999.5, 1e6, -6.84, 0.0, 123456.5, 0.5, 3e-7, 2.5e8 + 0.5]
    assert [one(spark, numeric.sig6(F.lit(v))) for v in numbers] == [float(f"{v:.6g}") for v in numbers]
    assert [one(spark, numeric.g_text(F.lit(v))) for v in numbers] == [f"{v:.6g}" for v in numbers]
    assert [one(spark, F.format_string("%.4f", numeric.rounded(F.lit(v), 4))) for v in (2.78125, 2.53125, 1.00005, 12.34565, 0.0)] == [f"{v:.4f}" for v in (2.78125, 2.53125, 1.00005, 12.34565, 0.0)]
    assert one(spark, numeric.percent_text(F.lit(1), F.lit(8))) == "12.50%" and one(spark, numeric.percent_text(F.lit(0), F.lit(0))) == "0.00%"
    assert one(spark, tx.clean_text(F.lit("﻿ a  b\n"))) == "a b" and one(spark, tx.clean_text(F.lit(" N.D. "))) is None
    assert one(spark, tx.edit_notes(F.lit("a; b;a"), ["c", F.lit(None).cast("string"), "b"], ["a"])) == "b; c"
    assert one(spark, tx.canonical_url(F.lit("HTTPS://Ex.org//a//b?z=2&&a=1#x"))) == "https://ex.org/a/b?a=1&z=2"
    urls = {"a/b?x=%20y&b": "a/b?b=&x= y", "/p?b=2": "/p?b=2", "http://h": "http://h/", "//H/p;q?x=a+b&x=1": "//h/p?x=1&x=a b", "http://h/a?k=%zz": "http://h/a?k=%zz"}
    assert {u: one(spark, tx.canonical_url(F.lit(u))) for u in urls} == urls
    assert one(spark, tx.safe_name(F.lit("https://x.org/A/b-c.d/?id=4"))).startswith("page_A_b-c.d_") and one(spark, tx.safe_name(F.lit("https://x.org"))).startswith("page_root_")
    none = F.lit(None).cast("string")
    assert [one(spark, tx.page_class(F.lit(u), F.lit(t), none)) for u, t in (("http://a/?id=3", "x"), ("http://a/?page=3", "x"), ("http://a/", "x"), ("http://a/", "IC50 of a peptide"), ("http://a/", "browse results"))] == ["detail_like", "list_like", "unknown", "detail_like", "list_like"]
    assert one(spark, tx.html_to_text(F.lit("<p>a &lt; b<script>x</script></p>\n<b>c</b>"))) == "a < b c"


def test_signal_features_against_numpy(spark):
    seqs = ["AP", "IPP", "VYWKDE", "GGG", "A"]
    got = {r.s: r.v for r in features.with_signal_features(spark.createDataFrame([(s,) for s in seqs], "s string"), "s", "v").collect()}
    for s in seqs:
        want = [s.count(a) / len(s) for a in tx.AMINO_ACIDS] + [len(s)]
        for scale in features.SCALES.values():
            x = np.array([scale[a] for a in s])
            ac = []
            for lag in (1, 2):
                a, b = x[:-lag], x[lag:]
                ac.append(float(np.corrcoef(a, b)[0, 1]) if len(x) > lag and np.std(x) > 1e-12 and np.std(a) > 1e-12 and np.std(b) > 1e-12 else 0.0)
            mag = np.abs(np.fft.rfft(x))
            centroid = float((np.arange(len(mag)) * mag).sum() / mag.sum()) if mag.sum() > 1e-12 else 0.0
            want += [x.mean(), x.std(), x.min(), x.max(), (x**2).mean(), *ac, (mag**2).sum(), centroid, np.argmax(mag) / max(1, len(mag) - 1)]
        assert got[s] == pytest.approx([*want, len(s)], abs=1e-6), s


def test_dedupes_and_numbers(spark):
    df = spark.createDataFrame([(1, 10, None, "x"), (1, 5, "b", None), (1, 7, "c", "y"), (None, 1, "z", "z")], "k int, o int, a string, b string")
    assert rel.keep_first(df, "k", F.col("o")).collect()[0][1:] == (5, "b", None, 3)
    assert rel.keep_last(df, "k", F.col("o")).collect()[0][1] == 10
    assert rel.keep_richest(df, "k", F.col("o"), ["a", "b"]).collect()[0][1] == 7
    n = rel.numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")), [F.col("v")]).collect()
    assert all(r.n == r.v + 1 for r in n) and len(n) == 1000
    assert rel.keep_first(df.limit(0), "k", F.col("o")).count() == 0 and rel.numbered(df.limit(0), [F.col("o")]).count() == 0


def test_html(spark):
    page = "<table><tr><td>a</td></tr></table><table><tr><th>ID</th><th>Name</th></tr><tr><td>1</td><td>x &amp; <b>y</b></td></tr></table><a href='/p?b=2'>go</a>"
    df = spark.createDataFrame([(1, page), (2, None), (3, "<td>broken")], "k int, h string")
    assert [tuple(r) for r in html.table_rows(df, "k", "h", ["Name", "ID"]).collect()] == [(1, 1, "x & y", "1")]
    assert df.select(html.links_of(F.col("h")).alias("l")).collect()[0].l[0].href == "/p?b=2"
    kv = spark.createDataFrame([("<table><tr><td>A:</td><td>1</td></tr><tr><td>A</td><td>2</td></tr></table>",)], "h string")
    assert kv.select(html.pairs_of(html.tables_of(F.col("h"))).alias("m")).first().m == {"A": "1"}


def test_sources_and_sinks(spark, tmp_path):
    head = "\t".join(readers.RAW_COLUMNS)
    (tmp_path / "raw.txt").write_text(head + "\n\n" + "\t".join(str(i) for i in range(12)) + "\n", encoding="utf-8")
    assert readers.read_raw_table(spark, str(tmp_path / "raw.txt"), "small").drop("ord").collect()[0][:2] == ("0", "1")
    (tmp_path / "bad.txt").write_text("a\tb\n", encoding="utf-8")
    with pytest.raises(readers.SchemaError):
        readers.read_raw_table(spark, str(tmp_path / "bad.txt"), "small")
    (tmp_path / "c.csv").write_bytes("名,b\n值,2\n".encode("gb18030"))
    assert readers.read_any_csv(spark, str(tmp_path / "c.csv"), ["名"]).collect()[0]["名"] == "值"
    (tmp_path / "cards").mkdir()
    (tmp_path / "cards" / "detail_report_7.txt").write_bytes("数值较高 IC50 : 5 uM".encode("gb18030"))
    rows = spark.createDataFrame([("7", None), ("8", "x\\detail_report_7.txt"), ("9", None)], "peptide_id string, raw_text_path string")
    joined = readers.with_detail_text(rows, readers.read_detail_texts(spark, str(tmp_path / "cards"))).orderBy("peptide_id").collect()
    assert [r.detail_text for r in joined] == ["数值较高 IC50 : 5 uM", "数值较高 IC50 : 5 uM", None]
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert writers.write_csv_file(df, str(tmp_path / "o.csv"), ["b", "a"]) == 2
    assert (tmp_path / "o.csv").read_text(encoding="utf-8-sig").splitlines()[:2] == ["b,a", ",1"]
    writers.overwrite_with_backup(df, str(tmp_path / "t"))
    assert writers.overwrite_with_backup(df.limit(1), str(tmp_path / "t")).endswith(".bak") and spark.read.parquet(str(tmp_path / "t")).count() == 1
    assert "<svg" in writers.bar_chart([("a", 1.0), ("b", -2.0)], "t", True) and "<svg" in writers.heatmap({("a", "b"): 1.0}, "t")
    calls = []

    def refuse(url):
        calls.append(url)
        raise OSError("no network")

    assert readers.fetch("http://x.example/", refuse, tries=2, wait=0)["ok"] is False and len(calls) == 2


def test_readers_of_other_forms(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("Peptide\tIC50\n#Advanced search parameters\tx\n\t\nAGK\t\"5\nuM\"\n", encoding="utf-8-sig")
    assert [tuple(r) for r in readers.read_tsv(spark, str(tmp_path / "m.tsv"), ["Peptide"]).collect()] == [("AGK", "5\nuM")]
    (tmp_path / "c.csv").write_text("a,b\n n.d. , x  y \n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "c.csv"), clean=True).collect()] == [(None, "x y")]
    assert readers.read_csv(spark, str(tmp_path / "c.csv"), multiline=False).count() == 1
    with pytest.raises(readers.SchemaError):
        readers.read_csv(spark, str(tmp_path / "c.csv"), ["z"])
    assert readers.first_match(str(tmp_path), ["*.none", "*.tsv"]).endswith("m.tsv") and readers.parse_args_paths(None, "b", "c") == "b"
    with pytest.raises(FileNotFoundError):
        readers.first_match(str(tmp_path), ["*.none"])
    (tmp_path / "r.txt").write_text("a  b\n\nx y   2\n1\t2\n", encoding="utf-8")
    assert readers.convert_text_to_csv(str(tmp_path / "r.txt"), str(tmp_path / "r.csv")) == "converted" and (tmp_path / "r.csv").read_text(encoding="utf-8-sig").splitlines() == ["a,b", "x y,2", "1,2"]
    assert readers.convert_text_to_csv(str(tmp_path / "r.txt"), str(tmp_path / "r.csv")) == "exists" and readers.convert_text_to_csv(str(tmp_path / "q"), str(tmp_path / "q.csv")) == "missing"


def test_download_keeps_bytes(tmp_path):
    import io

    body = bytes(range(256))
    to = str(tmp_path / "d" / "x.zip")

    class Response(io.BytesIO):
        status, headers = 200, {}

    assert readers.download("http://x.example/a", to, lambda u: Response(body))["ok"] and open(to, "rb").read() == body
    assert readers.download("http://x.example/a", to, None)["status"] == "exists"
    assert readers.fetch("http://x.example/a", lambda u: Response("值很高".encode("gb18030")))["text"] == "值很高"


def test_sinks_of_other_forms(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 1), (2, "x", 0)], "a int, b string, f int")
    writers.write_table(df, str(tmp_path / "t"), ["b"])
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["b"]
    with pytest.raises(Exception):
        writers.write_table(df, str(tmp_path / "t"))
    assert writers.write_csv_file(df, str(tmp_path / "o.csv"), ["a", "f"], {"a": "号"}, yes_no=["f"]) == 2
    assert (tmp_path / "o.csv").read_text(encoding="utf-8-sig").splitlines() == ["号,f", "1,是", "2,否"]
    assert writers.write_csv_file(df.limit(0), str(tmp_path / "e.csv"), ["a", "b"], placeholder={"a": "none"}) == 1 and writers.write_csv_file(df, str(tmp_path / "e.csv"), overwrite=False) == 0
    writers.write_json({"n": 1}, str(tmp_path / "s" / "x.json"))
    assert '"n": 1' in (tmp_path / "s" / "x.json").read_text() and writers.write_if_missing("a", str(tmp_path / "s" / "x.json")) is False
    assert writers.scaffold(str(tmp_path / "p"), ["a", "b"], {"r.md": "x"}) == ["a", "b", "r.md"] and writers.scaffold(str(tmp_path / "p"), ["a"], {"r.md": "y"}) == []
    svg = writers.grouped_bar_chart([("g", [1.0, 2.0])], ["s1", "s2"], "t")
    assert svg.count("<rect") == 4 and "s2" in svg and svg.count("<rect") != writers.bar_chart([("g", 1.0)], "t").count("<rect")
    assert writers.markdown_index("T", [("a", "b")]) == "# T\n\n- `a`: b\n" and writers.text_summary(df, 1).count("\n") == 0 and "<circle" in writers.scatter_chart([(1.0, 2.0, "x")], "t")


def test_ingest_takes_files_once(spark, tmp_path):
    from assaylake.streaming.ingest import ingest

    df = spark.range(5)
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def _canon(df: pd.DataFrame) -> list:
    def cell(v):
        if isinstance(v, (list, np.ndarray)):
            return str(list(v))
        if v is None or pd.isna(v):
            return None
        return round(float(v), 5) if isinstance(v, (int, float, np.number)) else str(v)

    return sorted((tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False)), key=str)


SMALLEST = SMALL.replace("sf0.01", "sf0.001")


@pytest.mark.parametrize("name", ["ic50_fermfood", "sequence_level", "consensus_tier", "highconf_aggregate", "terminal_enrichment", "reverse_pairs", "list_detail_fusion", "null_profile", "merged_ids", "context_rescue"])
def test_query_equals_sql(spark, name):
    from pathlib import Path

    con = duckdb.connect()
    for f in Path(SMALLEST).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    assert _canon(queries.queries()[name](spark, SMALLEST).toPandas()) == _canon(con.execute(queries.oracle_sql()[name]).df())


def test_every_branch_of_stability_occurs(spark):
    flags = {r.stability_flag for r in queries.stability_flag(spark, SMALLEST).collect()}
    assert flags == {"singleton", "unknown", "cross_source_consistent", "within_range_consistent", "conflicting"}


def test_document_queries_read_every_language(spark):
    import re

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {n: {r.doc_id: r for r in queries.queries()[n](spark, SMALL).collect()} for n in ("ic50_from_text", "year_extract", "page_keyword_hits", "page_class", "section_extract")}
    ids, cards = {r.doc_id for r in docs}, {r.doc_id for r in docs if r.doc_kind == "card"}
    assert all(set(got[n]) == ids for n in ("ic50_from_text", "page_keyword_hits", "page_class")) and set(got["section_extract"]) == cards
    number, unit = r"([0-9]+(?:\.[0-9]+)?)", r"(µM|μM|uM|nM|mM|M|micromole|micromolar)\b"
    patterns = [re.compile(p, re.I | re.A) for p in (rf"\bIC50\s*:?\s*([<>≤≥]?)\s*{number}\s*{unit}", rf"\bIC50\b.*?\b(?:was|is|of)\s*([<>≤≥]?)\s*{number}\s*{unit}", rf"\bIC50\s*:?\s*([<>≤≥]?)\s*{number}\b")]
    labels = "|".join(map(re.escape, queries.LABELS))
    foreign_values = 0
    for r in docs:
        text, g = r.text or "", got["ic50_from_text"][r.doc_id]
        hit = next((m for m in (p.search(text) for p in patterns) if m), None)
        assert (g.value, g.status == "missing") == (hit and round(float(hit[2]), 6), not hit), text
        foreign_values += bool(hit) and r.lang != "en"
        low = text.lower()
        assert got["page_keyword_hits"][r.doc_id].hits == " | ".join(w for w in queries.PAGE_WORDS if w in low)
        detail, listed = (sum(w in low for w in ws) for ws in (tx.DETAIL_WORDS, tx.LIST_WORDS))
        assert got["page_class"][r.doc_id].page_class == ("detail_like" if detail > listed else "list_like" if listed > detail else "unknown")
        years = [int(y) for y in re.findall(r"\b((?:19|20)\d{2})\b", text, re.A)]
        if years:
            assert (got["year_extract"][r.doc_id].latest, got["year_extract"][r.doc_id].earliest) == (max(years), min(years))
        if r.doc_id in cards:
            found = re.search(rf"Activity:(.*?)(?:{labels}|$)", text, re.I | re.S)
            want = " ".join(found[1].split()) if found else ""
            assert (got["section_extract"][r.doc_id].activity or "") == ("" if want.lower() in tx.MISSING_TOKENS else want)
    assert foreign_values > 10


def test_page_parsers(spark):
    b = one(spark, tx.bibliography(F.lit("Authors Smith J. Title A peptide of milk Food Chem. 12, 3 (2001) Year Source 2001 Journal")))
    assert tuple(b) == ("Smith J.", "A peptide of milk", "2001", "Journal")
    assert tuple(one(spark, tx.bibliography(F.lit("A book of 1999 and 2004")))) == (None, None, "2004", "Book") and tuple(one(spark, tx.bibliography(F.lit("")))) == (None, None, None, None)
    assert [tuple(one(spark, tx.activity_cell(F.lit(x)))) for x in (" 29.00  IC 50 ", "-4.4 ec50", "about")] == [("29.00", "IC50"), ("-4.4", "EC50"), ("about", "")]
    row = "<tr class='info'><td><a href='d?zm_ID=7'>x</a></td><td>7</td><td>n &amp; m</td><td>AGK</td><td>1.5</td><td>1.6</td><td>29.00<br>IC50</td></tr><tr class='info'><td>1</td></tr>"
    assert [tuple(r) for r in one(spark, tx.list_rows_of_html(F.lit(row)))] == [("7", "n & m", "AGK", "1.5", "1.6", "29.00", "IC50", "d?zm_ID=7")]
    assert [tuple(r) for r in one(spark, tx.list_rows_of_text(F.lit("x Peptide\nData 7 my name AGK 1.5 1.6 29.0 IC50 Page 1/3 Peptide Data none")))] == [("7", "my name", "AGK", "1.5", "1.6", "29.0", "IC50")]
    assert one(spark, tx.list_rows_of_text(F.lit("nothing"))) == [] and one(spark, tx.list_rows_of_html(F.lit(None).cast("string"))) is None
    assert one(spark, tx.total_pages(F.lit("Page 1 / 3 Page 2 / 9"))) == 9 and one(spark, tx.total_entries(F.lit("Total number of entries: 45"))) == 45
    assert one(spark, tx.page_candidates(F.lit("http://h/p?page=1"), F.lit(1)))[:2] == ["http://h/p?page=2", "http://h/p?page=1&pageno=2"]


def test_upgrades_and_conversion(spark):
    L = F.lit
    none, num = L(None).cast("string"), L(None).cast("double")
    assert [one(spark, ic50.stronger(L("exact_molar"), L(o), L(1.0), L("uM"), L("uM"))) for o in ("range", "mass_unit", "percent_like", "exact_molar")] == [True, True, True, False]
    assert one(spark, ic50.stronger(L("exact_molar"), L("exact_molar"), num, L("uM"), L("uM"))) and one(spark, ic50.stronger(L("exact_molar"), L("exact_molar"), L(1.0), none, L("uM"))) and not one(spark, ic50.stronger(L("range"), none, num, none, L("uM")))
    assert [one(spark, ic50.better(L("exact_molar"), L(2.0), L(o), L(u).cast("double"))) for o, u in (("exact_molar", 2.0), ("exact_molar", 3.0), ("exact_molar", None), ("range", 2.0))] == [False, True, True, True]
    df = spark.createDataFrame([("a", "mass_unit", "=", 0.06, "mg / mL", 300.0, None, 0), ("b", "mass_unit", ">", 1.0, "mg/mL", 300.0, None, 0), ("c", "exact", "=", 5.0, "uM", 300.0, 5.0, 1), ("d", "mass_unit", "=", 6.0, "µg/ml", 300.0, None, 0)], "id string, ic50_type string, ic50_relation string, ic50_value double, ic50_unit_raw string, molwt_value double, ic50_uM double, ic50_exact_flag int")
    got = {r.id: (r.ic50_type, r.ic50_uM, r.ic50_exact_flag, r.unit_conversion_applied) for r in ic50.convert_mass_units(df).collect()}
    assert got["a"] == ("exact", 200.0, 1, 1) and got["b"] == ("mass_unit", None, 0, 0) and got["c"] == ("exact", 5.0, 1, 0) and got["d"] == ("exact", 20.0, 1, 1)


def test_worksets_keep_and_route(spark):
    from assaylake.plans import worksets

    rows = [("a", "AGK", 3, "exact_molar", 5.0, None, "5 uM"), ("b", "A{P}", 2, "exact_molar", 5.0, "x; non_canonical_or_contains_unknown_residue", "5 EC50"), ("c", "AJ", None, "rescued_numeric_no_unit", 5.0, None, None), ("d", "AG", None, "exact_molar", 5.0, None, None), ("e", None, None, None, float("nan"), None, None)]
    df = spark.createDataFrame(rows, "id string, sequence string, peptide_length int, ic50_parse_status string, ic50_uM double, notes string, ic50_raw string").withColumn("length_consistency_flag", F.when(F.col("id") == "b", "conflict"))
    got = {r.id: r for r in worksets.annotated(df, "biopep").collect()}
    assert got["a"].workset_keep_flag == 1 and got["b"].workset_exclusion_reasons == "ec50_record; noncanonical_or_modified_residue; length_conflict"
    routes = worksets.routed(worksets.annotated(df, "biopep"), worksets.ROUTES["biopep"]).select("id", "route").collect()
    assert {tuple(r) for r in routes} == {("b", "ec50"), ("b", "noncanonical"), ("b", "length_conflict")}
    strict, wide = ({r.id: (r.workset_keep_flag, r.workset_exclusion_reasons) for r in worksets.annotated(df, "fermfood", m).collect()} for m in ("strict", "expanded"))
    assert strict["d"] == (1, "peptide_length_missing")  # kept, and excluded for its length too
    assert strict["c"][0] == wide["c"][0] == 0 and strict["e"][1] == "sequence_missing; peptide_length_missing; ic50_status_not_usable; ic50_uM_missing"
    assert worksets.annotated(df.limit(0), "mbpdb").count() == 0


def test_encoding_is_decided_by_the_whole_file(spark, tmp_path):
    filler = "plain,1\n" * 200_000  # more than a megabyte of ASCII before the first other byte
    for enc, word in (("utf-8", "值é"), ("gb18030", "值很高"), ("latin1", "Käse à")):
        (tmp_path / "c.csv").write_bytes(f"name,b\n{filler}{word},2\n".encode(enc))
        assert readers.sniff(str(tmp_path / "c.csv"))[0].replace("-sig", "") == enc
        assert readers.read_any_csv(spark, str(tmp_path / "c.csv"), ["name"]).where("b = '2'").collect()[0]["name"] == word
    (tmp_path / "split.csv").write_bytes(b"a;b\n" + b"x" * ((1 << 20) - 5) + "值;2\n".encode())  # a character across two blocks
    assert readers.sniff(str(tmp_path / "split.csv")) == ("utf-8-sig", ";")
    (tmp_path / "empty.csv").write_bytes(b"")
    assert readers.sniff(str(tmp_path / "empty.csv")) == ("utf-8-sig", ",")


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from assaylake import session

    def spark_of(master, named=None):
        unset = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))
        sc = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: unset), getConf=lambda: {}, setCheckpointDir=set_to.append)
        return SimpleNamespace(sparkContext=sc, conf={"spark.checkpoint.dir": named})

    set_to = []
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            session.shared_folder(spark_of(master))
    with pytest.raises(AttributeError):  # the folder of the setting is taken; the double has no way to give it back
        session.shared_folder(spark_of("yarn", "hdfs://shared/folder"))
    assert set_to == ["hdfs://shared/folder"]


def test_classification_without_stable_sequences(spark, tmp_path):
    spark.read.parquet(f"{SMALLEST}/lineitem.parquet").where("false").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = [tuple(r) for r in queries.svm_cv(spark, str(tmp_path)).collect()]
    metrics = ("accuracy", "macro_precision", "macro_recall", "macro_f1")
    assert sorted(got) == sorted((f, m, None) for f in ("composition", "signal", "fusion") for m in metrics)


def test_classes_stand_in_every_training_part(spark):
    schema = "k string, y double, x array<double>"
    rows = [(f"a{i}", 0.0, [1.0, float(i)]) for i in range(23)] + [(f"b{i}", 1.0, [9.0, float(i)]) for i in range(2)] + [("c", 2.0, [5.0, 5.0])]
    df = spark.createDataFrame(rows, schema)
    dealt = {}
    for r in classify.folded(df, "y", "k", 5).collect():
        dealt.setdefault(r.y, []).append(r.fold)
    assert {y: len(f) for y, f in dealt.items()} == {0.0: 23, 1.0: 2} and len(set(dealt[1.0])) == 2
    assert sorted(dealt[0.0].count(f) for f in range(5)) == [4, 4, 5, 5, 5]
    assert classify.fold_count(df.where("y <> 1"), "y") == 5 and classify.fold_count(df.limit(0), "y") == 2
    # One class of two rows, in whichever order their keys hash: each is predicted from the other.
    for i in range(4):
        pair = spark.createDataFrame([(f"{i}a", 1.0, [1.0]), (f"{i}b", 1.0, [2.0])], schema)
        assert {(r.label, r.prediction) for r in classify.cross_validated(pair, "y", "x", "k").collect()} == {(1.0, 1.0)}
    far = spark.createDataFrame([("a", 0.0, [0.0, 1.0]), ("b", 0.0, [0.1, 1.0]), ("c", 2.0, [9.0, 1.0]), ("d", 2.0, [9.1, 1.0])], schema)
    assert {(r.k, r.label, r.prediction) for r in classify.cross_validated(far, "y", "x", "k").collect()} == {("a", 0.0, 0.0), ("b", 0.0, 0.0), ("c", 2.0, 2.0), ("d", 2.0, 2.0)}
