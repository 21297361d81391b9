"""General data problems: examples, edge rows, and brute force over whole small tables."""

import math
import re
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaylake import training
from assaylake.operators import impute, orphans, recover, units
from conftest import SMALL

MISSING = {"", "na", "n/a", "nan", "none", "null", "-", "--", "nd", "n.d."}


def absent(s):
    return s is None or str(s).strip().lower() in MISSING


def potency(spark, rows):
    schema = "row_id long, source_name string, ic50_raw string, ic50_unit string, mass_raw string, mass_da double, q_nm string"
    df = spark.createDataFrame([(i, "FermFooDb", *r, "clash") for i, r in enumerate(rows)], schema)
    q = units.convert_potency(df).select("row_id", "q_kind", "q_dimension", units.half_up(F.col("q_nm")).alias("nm")).collect()
    return [(r.q_kind, r.nm) for r in sorted(q)]


def test_units_of_potency(spark):
    cases = {
        ("2.15±0.02 mM", None, None, None): 2150000,
        ("IC50 = 5 nM (n = 3)", None, None, None): 5,
        ("> 1,930 nmol/L", None, None, None): 1930,
        ("0,5 mM", None, None, None): 500000,
        ("1.2 x 10-5 M", None, None, None): 12000,
        ("1.5e-6 mol L-1", None, None, None): 1500,
        ("１２ μmol/㎖", None, None, None): 12000000,
        (".5 mg/ml", None, "500 Da", 500.0): 1000000,
        ("250 μg mL-1", None, "0.5 kDa", 0.5): 500000,
        ("5 mg/100 ml", None, None, 500.0): 100000,
        ("7", "mg/dl", None, 700.0): 100000,
        ("7", None, None, 700.0): None,
        ("7 mg/ml", None, None, None): None,
        ("7 mg/ml", None, None, -1.0): None,
        ("7 mg/ml", None, None, math.nan): None,
        ("5-10 nM", "nM", None, None): None,
        ("45 %", "nM", None, None): None,
        ("0 nM", None, None, None): None,
        ("l5 nM", None, None, None): None,
        ("n.d.", "nM", None, None): None,
        (None, "nM", None, None): None,
        ("", None, None, None): None,
        ("9" * 50000 + " nM", None, None, None): "long",
    }
    got = potency(spark, list(cases))
    for (key, want), (kind, nm) in zip(cases.items(), got, strict=True):
        if want != "long":
            assert nm == want, (key, kind, nm)


def test_ranges_come_out_in_micromolar(spark, tmp_path):
    cases = [
        ("1.2-3.4 mg/ml", None, "500 Da", 500.0, (2400.0, 6800.0, 500.0, "converted_range")),
        ("10 to 20 uM", "nM", None, None, (10.0, 20.0, None, "converted_range")),
        ("500 nM to 1.5 μM", None, None, None, (0.5, 1.5, None, "converted_range")),
        ("5 mM - 10 mM", None, None, None, (5000.0, 10000.0, None, "converted_range")),
        ("1.5e-6-2.5e-6 M", None, None, None, (1.5, 2.5, None, "converted_range")),
        ("5-10", "mM", None, None, (5000.0, 10000.0, None, "converted_range")),
        ("1-2 mg/ml", None, None, None, (None, None, None, "no_mass")),
        ("5-10", None, "0.7 kDa", 0.7, (None, None, 700.0, "no_unit")),
        ("0-10 nM", None, None, None, (None, None, None, "not_positive")),
        ("10-20 %", "nM", None, None, (None, None, None, "percent")),
        ("5-10 min", None, None, None, (None, None, None, "unknown_unit")),
        ("7 uM", None, None, None, (None, None, None, "converted")),
    ]
    schema = "row_id long, source_name string, ic50_raw string, ic50_unit string, mass_raw string, mass_da double"
    spark.createDataFrame([(i, "FermFooDb", *c[:4]) for i, c in enumerate(cases)], schema).write.parquet(f"{tmp_path}/fermfoodb_ace_master_clean.parquet")
    got = [(r.potency_um_low, r.potency_um_high, r.mass_da, r.potency_status) for r in sorted(training.p1_potency(spark, str(tmp_path)).collect())]
    assert got == [c[4] for c in cases]
    assert not any(r.potency_um for r in training.p1_potency(spark, str(tmp_path)).where("row_id < 11").collect())


def test_units_empty_and_repeated(spark):
    schema = "row_id long, source_name string, ic50_raw string, ic50_unit string, mass_raw string, mass_da double"
    assert units.convert_potency(spark.createDataFrame([], schema)).count() == 0
    twice = spark.createDataFrame([(1, "a", "5 nM", None, None, None)] * 2, schema)
    assert units.convert_potency(twice).count() == 2


LINES = {
    'FMDB1,AB,2,milk,actin,5,30,200.1,5 uM,2024-01-31': None,
    '"FMDB1","AB","2","milk, raw","a ""b""",,,,"5","2024-02-29"\r': None,
    'FMDB1,AB,2,"milk\nskim",actin,5,-20,200.1,5 uM, 2024-01-31 ': None,
    'FMDB1,AB,2,"milk,actin,5,30,200.1,5 uM,2024-01-31': "quoting",
    'FMDB1,AB,2,mi"lk,actin,5,30,200.1,5 uM,2024-01-31': "quoting",
    'FMDB1,AB,2,"milk" x,actin,5,30,200.1': "quoting",
    'FMDB1,AB,2,milk,actin,5,30,200.1,5 uM': "column_count",
    '': "column_count",
    'FMDB1,AB,2,milk,actin,15,30,200.1,5 uM,2024-01-31': "invalid_value",
    'FMDB1,AB,2,milk,actin,5,30,200.1,5 uM,2023-02-29': "invalid_value",
    'fmdb1,AB,2,milk,actin,5,30,200.1,5 uM,2024-01-31': "invalid_value",
    'FMDB1,AB,２,milk,actin,5,30,200.1,5 uM,2024-01-31': "invalid_value",
    'FMDB1,AB,61,milk,actin,5,30,200.1,5 uM,2024-01-31': "invalid_value",
    'FMDB1,AB,2,milk,actin,5,30,0,5 uM,2024-01-31': "invalid_value",
}


def test_line_verdicts(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*LINES, None])], "line_id long, raw_line string")
    got = {r.key: r.reason for r in recover.line_verdicts(df).collect()}
    assert [got.get(i) for i in range(len(LINES) + 1)] == [*LINES.values(), "column_count"]


def test_grammar_resumes_after_a_broken_quote():
    text = 'FMDB1,"a,b\nFMDB2,c,d\nFMDB3,"e"x,f\nFMDB4,g,"h\ni"\n'
    read = list(recover.Grammar(recover.EXPORT_ANCHOR).blob(text))
    assert [(f, r) for _, f, r, _ in read] == [(None, "quoting"), (["FMDB2", "c", "d"], None), (None, "quoting"), (["FMDB4", "g", "h\ni"], None)]
    assert read[0][3] == text.index("e\"x")


def test_grammar_resumes_only_where_a_record_stands():
    good = "FMDB2,AGK,3,milk,casein,,,,5 uM,2024-01-31"
    text = f'FMDB1,AGK,3,"milk\nFMDB99,see note",casein,,,,5 uM ba"d,2024-01-31\n{good}'
    read = list(recover.Grammar(recover.EXPORT_ANCHOR, width=10).blob(text))
    assert [(s, r) for s, _, r, _ in read] == [(0, "quoting"), (text.index(good), None)] and read[0][3] == text.index('"d,')
    # Line starts without ten fields behind them are no records; without any record the fault keeps the rest.
    assert [r for _, _, r, _ in recover.Grammar(recover.EXPORT_ANCHOR, width=10).blob('FMDB1,"a\nFMDB2,b,c\nFMDB3,d')] == ["quoting"]
    assert len(list(recover.Grammar(recover.EXPORT_ANCHOR, width=10).blob('FMDB1,"x\n' + 'FMDB2,"y" z\n' * 20000 + good))) == 2


def test_readings_have_a_place_and_meet_the_stored_status(spark, tmp_path):
    rows = [(1, "5 uM", "exact_molar"), (2, "9 min", "unparsed_text"), (3, "high", "exact_molar"), (4, None, None), (5, "IC50: 0 uM", "unparsed_text"), (6, "1.2-3 mM", None)]
    spark.createDataFrame(rows, "row_id long, ic50_raw string, ic50_parse_status string").write.parquet(f"{tmp_path}/fermfoodb_ace_master_clean.parquet")
    got = {r.row_id: (r.value, r.upper, r.reason, r["at"], r.stored_agrees) for r in training.p2_values(spark, str(tmp_path)).collect()}
    assert got == {1: (5.0, None, None, None, 1), 2: (9.0, None, "invalid_value", 2, 1), 3: (None, None, "invalid_value", 0, 0), 4: (None, None, None, None, None), 5: (0.0, None, "invalid_value", 2, 1), 6: (1.2, 3.0, None, None, None)}


def test_potency_verdicts(spark):
    fine = ["5 uM", "7", "1.2-3 mM", "3 to 4 umol L-1", "45 % inhibition", "n.d.", None, "1,930 nM", "2.6e-6 molar", "3+/-1 mg/ml", "5 μM (fig. 2)"]
    wrong = ["high", "0 uM", "-3 uM", "5..2 uM", "9 min", "3O.5 uM", "5e uM", "uM", "1.2.3", "n = 4", "12-", "5x10^ uM", "a" * 20000]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(fine + wrong)], "row_id long, ic50_raw string")
    got = {r.key for r in recover.potency_verdicts(df).collect()}
    assert got == set(range(len(fine), len(fine) + len(wrong)))


def test_orphans_against_brute_force(spark):
    read = lambda t: spark.read.parquet(f"{SMALL}/{t}.parquet").toPandas()
    lst, det, mc = read("fermfoodb_ace_list"), read("fermfoodb_ace_detail"), read("fermfoodb_ace_master_clean")
    pattern = re.compile("(?i)fmdb[\\s_\\-​‌‍⁠﻿\xad]*([0-9]+)")
    ids = lambda s: [int(x) for x in pattern.findall(s or "")]
    month = lambda t: None if pd.isna(t) else f"{t:%Y-%m}"

    def target(df, at):
        out = defaultdict(list)
        for s, a, w in zip(df.fmdb_id, df[at], df.withdrawn_at):
            for n in ids(s)[:1]:
                out[n].append((month(a), month(w)))
        return out

    to = {"list": target(lst, "crawled_at"), "detail": target(det, "fetched_at")}
    refs = [("fermfoodb_ace_list", "detail", r, n, month(t)) for r, s, t in zip(lst.row_id, lst.fmdb_id, lst.crawled_at) for n in ids(s)[:1]]
    refs += [("fermfoodb_ace_detail", "list", r, n, month(t)) for r, s, t in zip(det.row_id, det.fmdb_id, det.fetched_at) for n in ids(s)[:1]]
    refs += [("fermfoodb_ace_master_clean", "list", r, n, month(t)) for r, s, t in zip(mc.row_id, mc.notes, mc.standardized_at) for n in set(ids(s))]
    want = set()
    for table, t, row, n, p in refs:
        rows = to[t].get(n)
        by_then = [w for a, w in rows or [] if a <= p]
        kind = "missing" if not rows else "late" if not by_then else "deleted" if all(w and w <= p for w in by_then) else None
        if kind:
            want.add((table, row, n, kind, p))
    got = [tuple(r) for r in training.p4_found(spark, SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {w[3] for w in want} == {"missing", "late", "deleted"}


def test_orphans_of_empty_tables(spark):
    refs = spark.createDataFrame([("t", "list", 1, 5, "2024-01"), ("t", "list", 2, None, "2024-01")], "ref_table string, target string, row_id long, num long, period string")
    none = spark.createDataFrame([], "num long, first int, kept array<struct<arr:int,wd:int>>")
    assert [r.orphan_kind for r in orphans.orphans(refs, {"list": none}).collect()] == ["missing"]


def test_a_parent_without_arrival_is_there_but_late(spark):
    import datetime as dt

    at = dt.datetime(2024, 3, 5)
    parents = spark.createDataFrame([(5, None, None), (6, at, at), (7, at, None), (None, at, None)], "num long, a timestamp, w timestamp")
    p = orphans.parents(parents, F.col("num"), F.col("a"), F.col("w"))
    refs = spark.createDataFrame([("t", "list", i, n, "2024-03") for i, n in enumerate((5, 6, 7, 8))], "ref_table string, target string, row_id long, num long, period string")
    assert {r.num: r.orphan_kind for r in orphans.orphans(refs, {"list": p}).collect()} == {5: "late", 6: "deleted", 8: "missing"}


def test_source_default_and_mass_units(spark):
    schema = "row_id long, source_name string, ic50_raw string, ic50_unit string, mass_raw string, mass_da double"
    df = spark.createDataFrame([(1, "A", "7", None, None, None), (2, "B", "7", None, None, None), (3, "A", "7", "mM", None, None), (4, "A", "1 mg/ml", None, "0.5 kilodaltons", 0.5), (5, "A", "1 mg/ml", None, "500 g mol-1", 500.0), (6, "A", "1 mg/ml", None, "5 parsec", 500.0)], schema)
    q = {r.row_id: (r.q_nm, r.q_unit_from) for r in units.convert_potency(df, source_defaults={"A": "uM"}).collect()}
    assert q[1] == (7000.0, "source") and q[2] == (None, None) and q[3] == (7e6, "field") and [round(q[i][0]) for i in (4, 5, 6)] == [2000000] * 3


def test_fills_against_brute_force(spark):
    t = spark.read.parquet(f"{SMALL}/fermfoodb_ace_master_rescued.parquet").toPandas()
    norm = {c: [None if absent(v) else v.strip().lower() for v in t[c]] for c in training.RESCUED_TEXTS}
    norm["mass_da"] = [str(math.floor(v * 1000 + 0.5)) if v == v and v is not None and v > 0 else None for v in t.mass_da]
    key = [None if absent(s) else (b, re.sub(r"[-\s]", "", s).upper()) for b, s in zip(t.rescue_batch, t.sequence)]
    want = set()
    for field, values in norm.items():
        seen = defaultdict(set)
        for k, v in zip(key, values):
            if k and v is not None:
                seen[k].add(v)
        want |= {(r, field, *seen[k]) for r, k, v in zip(t.row_id, key, values) if k and v is None and len(seen[k]) == 1}
    got = [tuple(r) for r in training.p5_found(spark, SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    filled = training.p5_filled(spark, SMALL)
    assert filled.count() == len(t) and filled.where("mass_da_filled = 1 and mass_da is null").count() == 0


@pytest.fixture(params=[impute.GROUP_PATTERNS, 0])
def group_patterns(request, monkeypatch):
    """Both ways through the rounds: groups as arrays, and distributed sums."""
    monkeypatch.setattr(impute, "GROUP_PATTERNS", request.param)


def test_em_follows_the_likelier_component(spark, group_patterns):
    rows = [(1, 100.0, "a")] * 5 + [(1, 900.0, "b")] * 5 + [(1, None, "b"), (1, 900.0, None), (1, None, None), (2, None, None), (None, 5.0, None)]
    df = spark.createDataFrame(rows, "g long, m double, c string")
    got = {(r.g, r.m, r.c): r for r in impute.em_fill(df, ["g"], {"m": 1.0}, ["c"]).collect()}
    assert got[(1, None, "b")].m_fill > 800 and got[(1, 900.0, None)].c_fill == "b"
    assert 100 <= got[(1, None, None)].m_fill <= 900 and (got[(2, None, None)].m_fill, got[(2, None, None)].c_fill) == (None, None)
    assert not any(k[0] is None for k in got) and all(r.em_settled for r in got.values())
    assert not got[(1, None, "b")].m_certain and not got[(1, None, "b")].c_certain
    assert impute.em_fill(df.limit(0), ["g"], {"m": 1.0}, ["c"]).count() == 0


def test_em_posterior_of_one_value_is_certain(spark, group_patterns):
    rows = [(1, 250.0, "a", "x")] * 3 + [(1, 250.0, "b", "x"), (1, None, None, None), (1, None, "a", "x"), (2, 7.0, "q", None), (2, None, None, "y"), (2, 7.0, None, "y"), (2, 9.0, "q", "y")]
    df = spark.createDataFrame(rows, "g long, m double, c string, d string")
    got = {tuple(r)[:4]: r for r in impute.em_fill(df, ["g"], {"m": 1.0}, ["c", "d"]).collect()}
    r = got[(1, None, None, None)]
    assert (r.m_fill, r.m_certain, r.d_fill, r.d_certain, r.c_certain) == (250.0, True, "x", True, False) and r.c_fill in ("a", "b")
    r = got[(2, None, None, "y")]
    assert (r.c_fill, r.c_certain, r.m_certain) == ("q", True, False) and 7 <= r.m_fill <= 9
    assert got[(2, 7.0, "q", None)].d_fill == "y" and got[(2, 7.0, "q", None)].d_certain


def test_em_ways_agree_and_report_what_moves(spark, monkeypatch):
    import random

    random.seed(3)
    rows = [(g, random.choice([100.0, 100.0, 104.0, 300.0, None]), random.choice(["a", "b", None]), random.choice(["x", "y", "z", None])) for g in range(12) for _ in range(25)]
    df = spark.createDataFrame(rows, "g long, m double, c string, d string")

    def fills(bound, rounds=impute.MAX_ROUNDS):
        monkeypatch.setattr(impute, "GROUP_PATTERNS", bound)
        return {tuple(r)[:4]: tuple(r)[4:] for r in impute.em_fill(df, ["g"], {"m": 1.0}, ["c", "d"], rounds).collect()}

    assert fills(1000, 3) == fills(0, 3)
    assert all(v[-1] for v in fills(1000).values()) and not all(v[-1] for v in fills(1000, 3).values())


def test_em_fills_masked_values_better_than_the_group(spark):
    """Held-out values of groups of two kinds: the posterior uses the other fields, the group's own mode cannot."""
    import random

    random.seed(5)
    truth = [(i, i // 10 % 40, *((100.0 + i // 10 % 40, "low") if random.random() < 0.5 else (900.0 + i // 10 % 40, "high"))) for i in range(4000)]
    masked = [(i, g, None if i % 10 == 0 else m, None if i % 10 == 5 else c) for i, g, m, c in truth]
    df = spark.createDataFrame(masked, "i long, g long, m double, c string")
    got = {r.i: r for r in impute.fill_rows(df, "i", ["g"], {"m": 1.0}, ["c"]).collect()}
    assert all(abs(got[i].m_fill - m) <= 40 for i, g, m, c in truth if i % 10 == 0)
    assert all(got[i].c_fill == c for i, g, m, c in truth if i % 10 == 5)
