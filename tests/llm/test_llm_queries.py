"""The registered queries one after another in one Python worker, in several orders."""

import random
from collections import Counter

import pytest

from flowloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def alone(spark):
    return {name: rows_of(f(spark, SF)) for name, f in queries().items()}


def rows_of(df):
    return Counter(str(tuple(r)) for r in df.collect()), df.columns


@pytest.mark.parametrize("seed", [1])
def test_any_order(spark, alone, seed):
    """Workers are reused, so what one query leaves in them must not change another."""
    names = sorted(alone)
    random.Random(seed).shuffle(names)
    for name in names:
        assert rows_of(queries()[name](spark, SF)) == alone[name], name


def test_packing_before_coding_in_one_worker(spark):
    """op2 remembers words without their decoded form; op5 asks the same worker for it."""
    both = {k: f for k, f in queries().items() if k.startswith(("op2_", "op5_"))}
    got = []
    for order in (sorted(both), sorted(both, reverse=True)):
        got.append({k: Counter(map(str, both[k](spark, SF).coalesce(1).collect())) for k in order})
    assert got[0] == got[1]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(alone, spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows, cols = alone[name]
    assert Counter(map(str, con.sql(f"SELECT {', '.join(cols)} FROM ({oracle_sql()[name]})").fetchall())) == rows
