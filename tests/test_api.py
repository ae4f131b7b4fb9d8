"""The handle: argument checks, DAGs of paths, placement and profiling."""

import pytest

from flowloom.api import Algorithms
from flowloom.graph import from_arrays
from flowloom.model import FlowPlacement, FlowPolicyConfig
from flowloom.profiling import Profiler


@pytest.fixture(scope="module")
def engine(spark):
    return Algorithms(from_arrays(spark, 4, [0, 1, 0, 2], [1, 3, 2, 3], [5, 5, 3, 3], [1, 1, 2, 2], [10, 11, 12, 13]), Profiler(enabled=True))


def rows(spark, *pairs):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "query_id long, src int, dst int")


@pytest.mark.parametrize("pair", [(-1, 3), (4, 3), (0, 4), (None, 3), (0, None)])
def test_ends_are_checked(spark, engine, pair):
    for call in (engine.max_flow, engine.resolve_to_paths, engine.sensitivity, lambda q: engine.k_shortest_paths(q, 2), lambda q: engine.shortest_paths(q, to_dst=True)):
        with pytest.raises(ValueError):
            call(rows(spark, (0, 3), pair))


def test_masks_are_checked(spark, engine):
    for mask in ("array(7) AS nodes_out", "array(-1) AS edges_out", "array(4) AS edges_out"):
        with pytest.raises(ValueError):
            engine.max_flow(rows(spark, (0, 3)).selectExpr("*", mask))
    assert engine.max_flow(rows(spark, (0, 3)).selectExpr("*", "array(1) AS nodes_out")).first().total_flow == 3


def test_results(spark, engine):
    q = rows(spark, (0, 3))
    assert engine.max_flow(q).first().total_flow == 8
    assert {r.node: r.dist for r in engine.shortest_paths(q.selectExpr("query_id", "src", "-1 AS dst")).collect()} == {0: 0, 1: 1, 2: 2, 3: 2}
    assert [r.cost for r in engine.k_shortest_paths(q, 5).orderBy("path_no").collect()] == [2, 4]
    dags = {(r.path_no, r.node): r.dist for r in engine.k_shortest_paths(q, 5, dags=True).collect()}
    assert dags == {(0, 0): 0, (0, 1): 1, (0, 3): 2, (1, 0): 0, (1, 2): 2, (1, 3): 4}
    assert {(r.edge_id, r.loss) for r in engine.sensitivity(q).collect()} == {(0, 5.0), (1, 5.0), (2, 3.0), (3, 3.0)}
    with pytest.raises(ValueError):
        engine.k_shortest_paths(q, 0)


def test_placement_runs_once(spark, engine):
    d = spark.createDataFrame([(0, 5000 + k, 0, 3, k, 3.0) for k in range(3)], "scenario_id long, demand_id long, src int, dst int, flow_class int, volume double")
    done, ledger = engine.place_demands(d, FlowPolicyConfig(placement=FlowPlacement.PROPORTIONAL))
    assert [(r.placed, r.leftover) for r in done.orderBy("demand_id").collect()] == [(3, 0), (3, 0), (2, 1)]
    ids = [r.flow_id for r in ledger.select("flow_id", "demand_id").distinct().collect()]
    assert len(set(ids)) == len(ids) and max(ids) < 100
    out = {r.edge_id: r.f for r in ledger.groupBy("edge_id").agg({"flow": "sum"}).withColumnRenamed("sum(flow)", "f").collect()}
    assert out == {0: 5, 1: 5, 2: 3, 3: 3}


def test_profiling(engine):
    with engine.profiler.scope("a"), engine.profiler.scope("b"):
        pass
    names = [r[0] for r in engine.profiler.summary()]
    assert {"a", "b"} <= set(names)
    engine.profiler.reset()
    off = Profiler()
    with off.scope("x"):
        pass
    assert engine.profiler.summary() == [] and off.summary() == []
