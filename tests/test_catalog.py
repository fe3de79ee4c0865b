"""Registered queries against their SQL. All of them with COHORTSPARK_ALL=1, else a spread of quick ones."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as se  # noqa: E402
from check_oracle import TABLES, compare  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUICK = ("s01 s08 s09 p06 p09 p14 f02 f06 f12 f20 j09 j11_ j13 j15 j19 j22_p a04 a07 a14 a17 a22 w03 w04 w08 w12 k05 u01 q05_f e01_sessionize_12h e04 e07 e16 e20 e22 e23 e25 e26_a e36 e47_daily_r "
         "x03 x07_cuped_a x10 x16 x17 m07_logit_c m13 m22_u m25_its_t m28 flagship").split()
NAMES = [n for n in se.queries() if os.environ.get("COHORTSPARK_ALL") or any(n.startswith(p) for p in QUICK)]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    status, note, _ = compare(spark, con, name, FOLDER)
    assert status in ("ok", "rows-only"), note


def test_entry(spark):
    assert se.entry(spark).count() == 1


def test_every_oracle_belongs_to_a_query():
    assert set(se.oracle_sql()) <= set(se.queries())
