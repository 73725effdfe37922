import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelmill.operators import matching as M
from panelmill.operators import repair as R


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def test_unit_grams(spark):
    table = spark.createDataFrame([("배추", "포기", "봄", 2000.0, "a", 0), ("배추", "포기", None, 2500.0, "b", 1), ("무", "개", "x", 900.0, "c", 2)],
                                  "item_nm string, unit string, vrty_contains string, g_per_unit double, source string, line int")
    rows = spark.createDataFrame([("배추", "봄배추", "포기"), ("배추", "가을", "포기"), ("무", "무", "개"), ("쌀", None, "kg(20)"), ("물", "v", "L"), ("면", "v", "g"), ("배추", None, "포기")], "item_nm string, vrty_nm string, unit string")
    got = {(r.item_nm, r.vrty_nm, r.unit): (r.unit_g, r.unit_g_source) for r in M.unit_grams(rows, table).collect()}
    assert got == {("배추", "봄배추", "포기"): (2000.0, "table:a"), ("배추", "가을", "포기"): (2500.0, "table:b"), ("무", "무", "개"): (None, "missing"), ("쌀", None, "kg(20)"): (1000.0, "weight"),
                   ("물", "v", "L"): (1000.0, "weight"), ("면", "v", "g"): (1.0, "weight"), ("배추", None, "포기"): (2500.0, "table:b")}


def test_prefixes_count_once(spark):
    items = spark.createDataFrame([("a", "07"), ("a", "0702"), ("b", "")], "i string, p string")
    codes = spark.createDataFrame([("070200",), ("070100",), ("080000",)], "c string")
    assert sorted((r.i, r.c) for r in M.prefix_pairs(items, ["i"], "p", codes, "c").collect()) == [("a", "070100"), ("a", "070200")]


@pytest.mark.parametrize("inline", [2000, 0])
def test_longest_alias_inline_and_joined(spark, inline):
    al = spark.createDataFrame([("파", "파", 0), ("대파", "파", 1), ("양파", "양파", 2), ("파프리카", "파프리카", 3)], "alias string, item string, rank int")
    names = spark.createDataFrame([("파",), ("대파채",), ("쪽파",), ("양파대파",), ("파프리카",), ("물",)], "n string")
    got = {r.n: r.item for r in M.first_contained(names, "n", al, ["item"], inline=inline).collect()}
    assert got == {"파": "파", "대파채": "파", "양파대파": "파", "파프리카": "파프리카"}


def test_closed_season(spark):
    s = spark.createDataFrame([("고등어", "", "04-01", "06-30"), ("고등어", "2024", "04-23", "05-22"), ("대게", None, "06-01", "11-30")], "item_nm string, year string, start_md string, end_md string")
    d = lambda *a: dt.date(*a)
    rows = spark.createDataFrame([("고등어", d(2024, 4, 10)), ("고등어", d(2024, 5, 1)), ("고등어", d(2023, 4, 10)), ("고등어", d(2023, 7, 1)), ("대게", d(2023, 12, 1)), ("쌀", d(2023, 12, 1))], "i string, date date")
    got = {(r.i, r.date): (r.closed_season, r.closed_window, r.days_to_closed_start) for r in M.season_windows(rows, s, "i", "date").collect()}
    assert got[("고등어", d(2024, 4, 10))] == (0.0, 1.0, 13)
    assert got[("고등어", d(2024, 5, 1))][:2] == (1.0, 1.0)
    assert got[("고등어", d(2023, 4, 10))][:2] == (None, 1.0)
    assert got[("고등어", d(2023, 7, 1))] == (None, 0.0, (d(2024, 4, 23) - d(2023, 7, 1)).days)
    assert got[("대게", d(2023, 12, 1))] == (0.0, 0.0, (d(2024, 6, 1) - d(2023, 12, 1)).days)
    assert got[("쌀", d(2023, 12, 1))] == (0.0, 0.0, None)


def test_spikes_are_repaired_and_levels_kept(spark):
    p = [100, 100, 160, 101, 100, 160, 160, 160]
    rows = [("m", day(i), float(x)) for i, x in enumerate(p)] + [("m", day(40), 400.0), ("m", day(41), 160.0)]
    df = spark.createDataFrame(rows, "k string, date date, p double")
    got = [r.p for r in R.repair_spikes(df, ["k"], "date", "p").orderBy("date").collect()]
    assert got == [100, 100, 100, 101, 100, 160, 160, 160, 400, 160]  # the day after a long gap is no change
    assert R.drop_spikes(df, ["k"], "date", "p").count() == len(rows) - 1


def test_splice_one_to_many(spark):
    rows = [("A", "x", f"{i}", day(i), 100.0) for i in range(50)] + [("B", "x", "b", day(i), 150.0) for i in range(40, 90)] + [("C", "x", "c", day(i), 50.0) for i in range(60, 90)] + [("Z", "x", "z", day(3), 1.0)]
    df = spark.createDataFrame(rows, "name string, item string, code string, date date, p double")
    pairs = spark.createDataFrame([("x", "A", "B"), ("x", "A", "C"), ("x", "Q", "B")], "item string, old_name string, new_name string")
    out = R.splice_renamed(df, pairs, ["item"], ["name"], ["code"], "date", "p", ["p"])
    got = {(r.name, r.date): (r.p, r.code) for r in out.collect()}
    assert not any(n == "A" for n, _ in got)
    assert got[("B", day(0))] == (150.0, "b") and got[("C", day(0))] == (50.0, "c")
    assert got[("C", day(49))] == (50.0, "c") and ("C", day(55)) not in got
    assert got[("B", day(45))] == (150.0, "b") and got[("Z", day(3))] == (1.0, "z")
    assert out.count() == 40 + 50 + 50 + 30 + 1


def test_duplicate_series_against_all_pairs(spark):
    import itertools
    import random

    rng = random.Random(0)
    rows, vals = [], {}
    base = [round(rng.uniform(50, 60), 0) for _ in range(300)]
    for s in range(12):
        for i in range(300):
            v = base[i] if s < 5 and rng.random() < (0.99 if s < 3 else 0.9) else round(rng.uniform(50, 60), 0)
            if rng.random() < 0.95:
                rows.append((f"s{s:02d}", day(i), float(v)))
                vals[(f"s{s:02d}", i)] = v
    want = set()
    names = sorted({r[0] for r in rows})
    for a, b in itertools.combinations(names, 2):
        both = [i for i in range(300) if (a, i) in vals and (b, i) in vals]
        if len(both) >= 200 and sum(vals[(a, i)] == vals[(b, i)] for i in both) / len(both) >= 0.95:
            want.add((a, b))
    df = spark.createDataFrame(rows, "s string, date date, p double")
    assert {(r.series_a, r.series_b) for r in M.duplicate_series(df, "s", "date", "p").collect()} == want and want


def test_override_and_fallback(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    o = spark.createDataFrame([(1, "제외"), (3, "c")], "k int, v string")
    assert {r.k: r.v for r in M.override(df, o, "k", "v", "제외").collect()} == {1: None, 2: "b", 3: "c"}
    rows = spark.createDataFrame([("i", "서울", day(1), 1.0), ("i", "전국", day(2), 2.0)], "item string, region string, date date, v double")
    req = spark.createDataFrame([("i", "서울", day(1)), ("i", "부산", day(2)), ("i", "부산", day(9)), ("j", "부산", day(9))], "item string, region string, date date")
    got = {(r.item, r.date): (r.v, r.source) for r in M.fallback_rows(req, rows, "item", "region", "date", "전국", "v").collect()}
    assert got == {("i", day(1)): (1.0, "region"), ("i", day(2)): (2.0, "national"), ("i", day(9)): (2.0, "last"), ("j", day(9)): (None, "none")}
