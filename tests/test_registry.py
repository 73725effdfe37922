import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import close, norm

SF = "/root/testdata/sf0.001"
SAMPLE = ["a02_trade_totals", "a09_ordered_distinct_concat", "a33_volume_price_correlation", "f02_clean_ingredients", "j03_asof_by_key", "j07_prefix_join", "j09_unit_priority_match", "j10_longest_alias_match",
          "m20_shown_probability", "m21_monthly_refit_last_12", "m24_weekly_stocking_policy", "p01_lenient_numbers", "s04_csv_ms949", "w09_target_change", "w21_typed_changes", "w24_volume_vs_normal",
          "w31_repaired_rows", "w38_size_chunks", "d03_trades_by_item", "d21_cooccurrence_ppmi"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 190


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["channel", "date", "price", "base", "r28", "y"] and df.count() > 1000


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = lambda rows: sorted(rows, key=lambda r: str([(x is None, f"{x:.5f}" if isinstance(x, float) else x) for x in r]))
    got = order(tuple(norm(r[c]) for c in cols) for r in df.collect())
    want = order(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert len(got) == len(want)
    assert all(all(close(a, b) for a, b in zip(g, w)) for g, w in zip(got, want))
