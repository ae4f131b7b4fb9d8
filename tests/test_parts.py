"""Graphs that no process may hold whole: each query gets the part that it needs."""

import pytest
from test_queries import DATA, duck, same  # noqa: F401

from flowloom import graph as graphs
from flowloom.model import EdgeSelection, FlowPlacement, FlowPolicyConfig, MaxFlowOptions
from flowloom.operators import batch
from flowloom.plans.queries import ORACLES, QUERIES, rounded

NAMES = ["batch_failures", "edge_flows", "max_flow_single_tier", "capped_paths", "min_cut_capacity", "ksp_within_factor", "ksp_costs", "ksp_dag_distances", "policy_cost_factor", "max_flow_cost_distribution", "single_edge_selection", "resolve_paths", "max_flow_equal_balanced", "policy_even", "policy_wcmp", "ledger_flows", "ledger_remove_class", "split_paths", "reachable_after_flow"]


@pytest.fixture
def small_process(monkeypatch):
    """A process holds fewer edges than the two-hop network of sf0.001 has."""
    monkeypatch.setattr(graphs, "LOCAL_EDGES", 100)
    monkeypatch.setattr(graphs, "MAX_LOCAL_EDGES", 100)


@pytest.mark.parametrize("name", NAMES)
def test_query_in_parts(spark, duck, small_process, name):  # noqa: F811
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(r) for r in df.select(cols).collect())
    want = sorted(duck.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall())
    assert len(got) == len(want)
    assert all(same(x, y) for g, w in zip(got, want) for x, y in zip(g, w)), [(g, w) for g, w in zip(got, want) if g != w][:3]


def test_rounding_at_a_half_is_that_of_duckdb(spark, duck):  # noqa: F811
    values = [130.0725, 1.005, 2.675, 0.5, 12.3456, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for places in (2, 3):
        got = [r[0] for r in df.select(rounded("v", places)).collect()]
        assert got == [duck.sql(f"SELECT ROUND(CAST({v} AS DOUBLE), {places})").fetchall()[0][0] for v in values]


def rows(df):
    return sorted(map(str, df.collect()))


def test_parts_and_whole_agree(spark, monkeypatch):
    """Cycles, parallel edges, dead ends, closed edges, masks and bad pairs: equal rows both ways."""
    import random

    rng = random.Random(5)
    n = 14
    ends = [(rng.randrange(n), rng.randrange(n)) for _ in range(40)] + [(0, 12), (12, 13), (3, 13)]
    ends = [(u, v) for u, v in ends if u != v and u != 13]
    caps = [float(rng.choice([0, 1, 2, 5, 9])) for _ in ends]
    g = graphs.from_arrays(spark, n, *zip(*ends), caps, [rng.randrange(1, 4) for _ in ends])
    pairs = [(i, s, d) for i, (s, d) in enumerate((a, b) for a in range(0, n, 2) for b in range(n))]
    good = spark.createDataFrame(pairs, "query_id long, src int, dst int")
    odd = good.unionByName(spark.createDataFrame([(900, 0, 99), (901, -1, 2), (902, 5, 5)], good.schema))
    lost = spark.createDataFrame([(0, 4), (0, 5), (1, 0)], "scenario_id long, node int")
    gone = spark.createDataFrame([(0, 3), (1, 8), (1, 9)], "scenario_id long, edge_id int")
    masked = batch.with_masks(odd.selectExpr("*", "query_id % 3 AS scenario_id"), lost, gone)
    demands = good.selectExpr("query_id % 5 AS scenario_id", "query_id AS demand_id", "src", "dst", "0 AS flow_class", "3.0D AS volume")
    even = FlowPolicyConfig(placement=FlowPlacement.EQUAL_BALANCED, min_flow_count=2, max_flow_count=3, selection=EdgeSelection(multi_edge=False))

    def all_of():
        yield batch.max_flow(g, masked)
        yield batch.max_flow(g, masked, MaxFlowOptions(with_reachable=True))
        yield batch.edge_flows(g, masked)
        yield batch.sensitivity(g, masked)
        yield batch.resolve_to_paths(g, good, split_parallel_edges=True)
        yield batch.spf(g, good)
        yield batch.ksp(g, masked, 5)
        yield batch.ksp_dags(g, good, 2)
        for config in (FlowPolicyConfig(), even, FlowPolicyConfig(excluded_nodes=frozenset({6}), excluded_edges=frozenset({2}))):
            yield from batch.place_demands(g, demands, config)

    whole = [rows(df) for df in all_of()]
    monkeypatch.setattr(graphs, "LOCAL_EDGES", 1)
    monkeypatch.setattr(graphs, "MAX_LOCAL_EDGES", 1)
    assert [rows(df) for df in all_of()] == whole


def test_a_part_may_be_too_large(spark, monkeypatch):
    monkeypatch.setattr(graphs, "MAX_LOCAL_EDGES", 1)
    import pyarrow as pa

    edges = pa.table({"edge_id": [0, 1], "src": [0, 0], "dst": [1, 1], "capacity": [1.0, 1.0], "cost": [1, 1]})
    with pytest.raises(ValueError, match="part of one query"):
        batch.part_net(2, edges, [0, 1])
