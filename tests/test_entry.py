import __spark_entry__ as entry
import duckdb
import glob
import os

import pytest

SAMPLE = ["prob_stats", "connected_components", "nms_hard", "ctc_text", "clean_text", "page_strategy", "hybrid_quality", "gap_session_counters", "batch_csv_rows"]


def test_registry():
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known) and len(known) > 80


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "confidence" in out.columns


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = entry.queries()[name](spark, data)
    names = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name]).project(", ".join(names)).fetchall()
    key = lambda r: tuple(str(round(v, 9) + 0.0) if isinstance(v, float) else str(v) for v in r)
    assert sorted(key(tuple(r)) for r in got.select(*names).collect()) == sorted(map(key, want))
