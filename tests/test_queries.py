"""Every graph query with SQL against DuckDB at sf0.001."""

import glob
import math
from pathlib import Path

import pytest

from flowloom.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, abs_tol=2e-4)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(r) for r in df.select(cols).collect())
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    want = sorted(duck.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall())
    assert len(got) == len(want)
    assert all(same(x, y) for g, w in zip(got, want) for x, y in zip(g, w)), [(g, w) for g, w in zip(got, want) if g != w][:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
