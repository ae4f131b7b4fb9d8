"""Kernels against slow second implementations on random graphs, and hand-made topologies.

Edges are (src, dst, cost, capacity).
"""

import itertools
import math

import numpy as np
import pytest

from flowloom.functions import flows, paths
from flowloom.functions.flows import State, max_flow, sensitivity
from flowloom.functions.paths import Gate, k_shortest, path_dag, resolve_paths, shortest_paths
from flowloom.functions.policy import FlowGraph, FlowPolicy
from flowloom.graph import Net
from flowloom.model import EdgeSelection, EdgeTieBreak, FlowIndex, FlowPlacement, FlowPolicyConfig, MaxFlowOptions

P, E = FlowPlacement.PROPORTIONAL, FlowPlacement.EQUAL_BALANCED
#: a short thin way, a longer wide one, and a pair of parallel last hops
FORK = Net.of(5, [(0, 1, 1, 4), (1, 4, 1, 1), (1, 4, 1, 2), (0, 2, 2, 6), (2, 4, 1, 5), (0, 3, 4, 9), (3, 4, 4, 9)])
FULL4 = Net.of(4, [(a, b, 1, 1) for a in range(4) for b in range(4) if a != b])
FAN = Net.of(6, [(0, m, 1, 4) for m in (1, 2, 3, 4)] + [(m, 5, 1, 4) for m in (1, 2, 3, 4)])


def random_net(seed, n=6, m=16, parallel=True):
    rng = np.random.default_rng(seed)
    ends = rng.integers(0, n, (m, 2)).tolist()
    ends = ends if parallel else sorted(set(map(tuple, ends)))
    return Net.of(n, [(int(a), int(b), int(rng.integers(1, 5)), float(rng.integers(0, 8))) for a, b in ends if a != b])


def simple_paths(net, src, dst):
    """All loop-free paths as edge lists."""
    out, stack = [], [(src, [], {src})]
    while stack:
        u, edges, seen = stack.pop()
        if u == dst:
            out.append(edges)
            continue
        stack += [(int(net.dst[e]), [*edges, e], seen | {int(net.dst[e])}) for e in range(net.m) if net.src[e] == u and int(net.dst[e]) not in seen]
    return out


def cost(net, edges):
    return sum(net.costs[e] for e in edges)


def flow(net, s, t, **kw):
    return max_flow(net, s, t, MaxFlowOptions(**kw))


@pytest.mark.parametrize("seed", range(12))
def test_spf_against_enumeration(seed):
    net = random_net(seed)
    dist, dag = shortest_paths(net, 0, None, Gate(net))
    for t in range(1, net.n):
        every = simple_paths(net, 0, t)
        assert (t in dist) == bool(every)
        if every:
            best = min(cost(net, p) for p in every)
            shortest = {tuple(p) for p in every if cost(net, p) == best}
            assert dist[t] == best
            assert {tuple(e[0] for _, e in p[:-1]) for p in resolve_paths(dag, 0, t, split=True)} == shortest
            single = shortest_paths(net, 0, t, Gate(net), False, EdgeSelection(multi_edge=False))[1]
            (one,) = resolve_paths(single, 0, t)
            assert tuple(e[0] for _, e in one[:-1]) in shortest
            # at equal cost the widest way wins
            assert min(net.cap[e[0]] for _, e in one[:-1]) <= max(min(net.cap[e] for e in p) for p in shortest)


@pytest.mark.parametrize("seed", range(12))
def test_ksp_against_enumeration(seed):
    """On graphs without parallel edges: of those, a prefix bars all that share its nodes, so some paths are not listed."""
    net = random_net(seed, m=16, parallel=False)
    for t in range(1, net.n):
        every = sorted(cost(net, p) for p in simple_paths(net, 0, t))
        got = k_shortest(net, 0, t, 6)
        assert [c for c, _ in got] == every[:6]
        assert len({tuple(p) for _, p in got}) == len(got)
        if every:
            assert [c for c, _ in k_shortest(net, 0, t, 6, factor=1.5)] == [c for c in every if c <= 1.5 * every[0]][:6]
            for c, edges in got:
                dist, dag = path_dag(net, 0, edges)
                assert dist[t] == c and [e[0] for _, e in resolve_paths(dag, 0, t)[0][:-1]] == edges


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("placement", [P, E])
def test_max_flow_properties(seed, placement):
    net = random_net(seed, m=20)
    for t in range(1, net.n):
        s = flow(net, 0, t, placement=placement, with_edge_flows=True, with_residuals=True, with_reachable=True)
        total, used = s.total_flow, s.edge_flows if s.edge_flows is not None else []
        for v in range(net.n):
            inflow, outflow = (sum(f for e, f in enumerate(used) if col[e] == v) for col in (net.dst, net.src))
            assert outflow - inflow == pytest.approx(total if v == 0 else -total if v == t else 0, abs=1e-6)
        assert all(f <= c + 1e-9 and r == pytest.approx(c - f, abs=1e-6) for f, c, r in zip(used, net.cap, s.residuals or []))
        assert [c for c, _ in s.cost_dist] == sorted(c for c, _ in s.cost_dist) and sum(f for _, f in s.cost_dist) == pytest.approx(total)
        # no more than any cut holds
        cuts = [sum(net.cap[e] for e in range(net.m) if net.src[e] in side and net.dst[e] not in side) for r in range(net.n) for more in itertools.combinations([v for v in range(1, net.n) if v != t], r) for side in [{0, *more}]]
        assert total <= min(cuts) + 1e-9
        if s.reachable is not None and s.min_cut:
            assert s.reachable[0]
            assert all(s.reachable[int(net.src[e])] and not s.reachable[int(net.dst[e])] for e in s.min_cut)


@pytest.mark.parametrize("seed", range(12))
def test_sensitivity_by_definition(seed):
    net = random_net(seed, m=18)
    for t in range(1, net.n):
        base = flow(net, 0, t, with_residuals=True)
        want = {}
        for e, r in enumerate(base.residuals or []):
            lost = base.total_flow - max_flow(net, 0, t, edges_out=[e]).total_flow
            if r <= 1 / 4096 and lost > 1 / 4096:
                want[e] = lost
        assert dict(sensitivity(net, 0, t)) == pytest.approx(want if base.total_flow else {})


def test_spf_gates():
    net = Net.of(2, [(0, 1, 1, 0), (0, 1, 1, 1)])
    assert shortest_paths(net, 0, 1, Gate(net, require_capacity=True))[1].parents[1] == [(0, [1])]
    assert shortest_paths(FORK, 0, None, Gate(FORK, nodes_out=[0]))[0] == {}
    assert shortest_paths(FORK, 0, 4, Gate(FORK, nodes_out=[1]))[0][4] == 3
    big = Net.of(3, [(0, 1, 2**53 + 1, 1), (1, 2, 2**53 + 1, 1)])
    assert shortest_paths(big, 0, 2, Gate(big))[0][2] == 2 * (2**53 + 1)


def test_parallel_edges():
    net = Net.of(2, [(0, 1, 3, 2), (0, 1, 3, 8), (0, 1, 4, 9)])
    assert shortest_paths(net, 0, 1, Gate(net))[1].parents[1] == [(0, [0, 1])]
    first = EdgeSelection(multi_edge=False)
    assert shortest_paths(net, 0, 1, Gate(net), selection=first)[1].parents[1] == [(0, [0])]
    wide = EdgeSelection(multi_edge=False, tie_break=EdgeTieBreak.PREFER_HIGHER_RESIDUAL)
    assert shortest_paths(net, 0, 1, Gate(net), selection=wide)[1].parents[1] == [(0, [1])]
    assert shortest_paths(net, 0, 1, Gate(net, [9.0, 1.0, 1.0]), selection=wide)[1].parents[1] == [(0, [0])]


def test_cycles_of_zero_cost():
    """Only a cycle that the search meets raises."""
    edges = [(0, 1, 1, 1), (1, 2, 0, 1), (2, 1, 0, 1), (2, 3, 1, 1), (0, 3, 1, 1)]
    loop = Net.of(4, edges)
    with pytest.raises(ValueError):
        shortest_paths(loop, 0, None, Gate(loop))
    assert shortest_paths(loop, 0, None, Gate(loop, nodes_out=[2]))[0] == {0: 0, 1: 1, 3: 1}
    assert shortest_paths(loop, 3, None, Gate(loop))[0] == {3: 0}


def test_paths():
    net = Net.of(3, [(0, 1, 1, 1), (0, 1, 1, 1), (1, 2, 1, 1), (1, 2, 1, 1)])
    dag = shortest_paths(net, 0, 2, Gate(net))[1]
    assert len(resolve_paths(dag, 0, 2)) == 1
    assert len(resolve_paths(dag, 0, 2, split=True)) == 4 and len(resolve_paths(dag, 0, 2, split=True, limit=3)) == 3
    assert resolve_paths(dag, 1, 1) == [[(1, ())]]


def test_ksp_arguments():
    with pytest.raises(ValueError):
        k_shortest(FULL4, 0, 1, 0)
    assert len(k_shortest(FULL4, 0, 1, 9, factor=1.0)) == 1 and k_shortest(FULL4, 0, 0, 3) == [] and k_shortest(FULL4, 0, 9, 3) == []


@pytest.mark.parametrize(
    "net,s,t,kw,tiers",
    [
        # the thin way holds 3 over two parallel hops, the next one 5, the last one 9
        (FORK, 0, 4, {}, [(2, 3.0), (3, 5.0), (8, 9.0)]), (FORK, 0, 4, {"shortest_path": True}, [(2, 3.0)]),
        # evenly, the two parallel hops hold 1 each, then 1 on the wider one
        (FORK, 0, 4, {"placement": E}, [(2, 3.0), (3, 5.0), (8, 9.0)]), (FORK, 0, 4, {"placement": E, "shortest_path": True}, [(2, 2.0)]),
        (FULL4, 0, 1, {}, [(1, 1.0), (2, 2.0)]), (FAN, 0, 5, {"placement": E}, [(2, 16.0)]),
        (Net.of(4, [(0, 1, 1, 6), (1, 3, 1, 6), (0, 2, 1, 8), (2, 3, 1, 0)]), 0, 3, {}, [(2, 6.0)]),
    ],
)
def test_tiers(net, s, t, kw, tiers):
    assert dict(flow(net, s, t, **kw).cost_dist) == pytest.approx(dict(tiers))


def test_degenerate():
    for s, t in ((0, 0), (-1, 2), (0, 9)):
        assert flow(FORK, s, t).total_flow == 0
    assert max_flow(FORK, 0, 4, nodes_out=[4]).total_flow == 0 and max_flow(FORK, 0, 4, edges_out=range(FORK.m)).min_cut == []


def test_place_amount():
    net = Net.of(3, [(0, 1, 1, 12), (1, 2, 1, 2), (1, 2, 1, 6)])
    dag = shortest_paths(net, 0, 2, Gate(net))[1]
    s, trace = State(net), []
    assert s.place(0, 2, dag, 4, P, trace) == pytest.approx(4) and s.flow == pytest.approx([4, 1, 3])
    assert dict(trace) == pytest.approx({0: 4.0, 1: 1.0, 2: 3.0})
    s.reset()
    assert s.flow == [0, 0, 0] and s.place(0, 2, dag, math.inf, E) == pytest.approx(4) and s.flow == pytest.approx([4, 2, 2])
    s.apply([(0, 1.0)], add=False)
    assert s.flow[0] == 3 and s.rest[0] == 9
    with pytest.raises(ValueError):
        State(net, [1.0])


def one(net, s, t, volume, **kw):
    book, policy = FlowGraph(net), FlowPolicy(net, FlowPolicyConfig(**kw))
    got = policy.place_demand(book, s, t, 0, volume)
    assert got[0] + got[1] == pytest.approx(volume, abs=1e-6)
    assert all(-1e-9 <= r <= c + 1e-9 for r, c in zip(book.state.rest, net.cap))
    return got[0], policy, book


@pytest.mark.parametrize(
    "volume,kw,placed",
    [
        (2, {}, 2), (7, {}, 7), (30, {}, 17), (30, {"shortest_path": True}, 3),
        (30, {"max_path_cost": 3}, 3), (30, {"max_path_cost_factor": 1.5}, 8), (30, {"max_path_cost_factor": 1.5, "max_path_cost": 2}, 3),
        (30, {"excluded_nodes": frozenset([1])}, 14), (30, {"multipath": False, "max_flow_count": 1}, 9),
        (9, {"placement": E, "shortest_path": True}, 2),
    ],
)
def test_policy(volume, kw, placed):
    """FORK holds 3 at cost 2, 5 at cost 3 and 9 at cost 8."""
    if "excluded_nodes" in kw or kw.get("multipath") is False:
        assert one(FORK, 0, 4, volume, **kw)[0] <= placed + 1e-9
    else:
        assert one(FORK, 0, 4, volume, **kw)[0] == pytest.approx(placed, abs=1e-6)


def test_even_flows_are_rebalanced_without_a_maximum():
    net = Net.of(2, [(0, 1, 1, 100)])
    placed, policy, _ = one(net, 0, 1, 10, placement=E, min_flow_count=2)
    assert placed == pytest.approx(10) and [f.placed for f in policy.flows.values()] == pytest.approx([5, 5])


def test_bounded_even_flows():
    sel = EdgeSelection(multi_edge=False, require_capacity=True)
    placed, policy, book = one(FAN, 0, 5, 12, placement=E, multipath=False, min_flow_count=4, max_flow_count=4, selection=sel)
    assert placed == pytest.approx(12) and [f.placed for f in policy.flows.values()] == pytest.approx([3] * 4)
    policy.remove_demand(book)
    assert book.state.rest == pytest.approx(FAN.cap.tolist()) and not book.ledger and policy.placed_demand == 0


def test_static_paths():
    paths = [(0, 5, shortest_paths(FAN, 0, 5, Gate(FAN, nodes_out={1, 2, 3, 4} - {m}))[1], 2) for m in (1, 2)]
    book, policy = FlowGraph(FAN), FlowPolicy(FAN, FlowPolicyConfig(max_flow_count=2))
    with pytest.raises(ValueError):
        policy.set_static_paths(paths[:1])
    policy.set_static_paths(paths)
    placed, left = policy.place_demand(book, 0, 5, 0, 20)
    assert placed + left == pytest.approx(20) and 0 < placed <= 8 + 1e-9
    with pytest.raises(ValueError):
        other = FlowPolicy(FAN, FlowPolicyConfig(max_flow_count=2))
        other.set_static_paths([(1, 5, paths[0][2], 2)] * 2)
        other.place_demand(book, 0, 5, 0, 1)


def test_ledger():
    net = Net.of(3, [(0, 1, 1, 6), (1, 2, 1, 6)])
    dag = shortest_paths(net, 0, 2, Gate(net))[1]
    book = FlowGraph(net)
    a, b = FlowIndex(0, 2, 0, 0), FlowIndex(0, 2, 1, 1)
    assert book.place(a, 0, 2, dag, 1.5, P) + book.place(b, 0, 2, dag, 2.5, P) == pytest.approx(4)
    assert book.flow_path(a) == [0, 1] and book.flow_edges(b) == [(0, 2.5), (1, 2.5)]
    book.remove_by_class(0)
    assert book.state.rest == pytest.approx([3.5, 3.5])
    book.remove(b)
    assert book.state.rest == pytest.approx([6, 6]) and book.flow_edges(b) == []
    book.place(a, 0, 2, dag, 2.0, P)
    book.reset()
    assert not book.ledger and book.state.rest == [6, 6]


def test_flow_path_sees_thin_branches():
    net = Net.of(4, [(0, 1, 1, 6), (1, 3, 1, 6), (0, 2, 1, 1), (2, 3, 1, 1)])
    book, index = FlowGraph(net), FlowIndex(0, 3, 0, 0)
    book.ledger[index] = {0: 5.0, 2: 1e-6, 1: 1e-6, 3: 5.0}
    assert book.flow_path(index) == []


def test_grid_distance():
    n = 20
    net = Net.of(n * n, [(i * n + j, i * n + j + 1, 1, 1) for i in range(n) for j in range(n - 1)] + [(i * n + j, i * n + n + j, 1, 1) for i in range(n - 1) for j in range(n)])
    assert shortest_paths(net, 0, n * n - 1, Gate(net))[0][n * n - 1] == 2 * (n - 1)


def loose_net(rng, n, most):
    ends = [(u, v, rng.randint(1, 3), float(rng.choice([0, 1, 2, 5, 9]))) for u, v in (rng.sample(range(n), 2) for _ in range(rng.randint(3, most)))]
    return Net.of(n, ends)


def test_sensitivity_by_branches_equals_whole_refills():
    import random

    rng, several = random.Random(3), 0
    for _ in range(400):
        net = loose_net(rng, rng.randint(3, 8), 18)
        nodes, barred = frozenset(v for v in range(1, net.n - 1) if rng.random() < 0.1), frozenset(e for e in range(net.m) if rng.random() < 0.1)
        several += len(flows.branches(net, 0, net.n - 1, nodes, barred)) > 1
        got, want = flows.sensitivity(net, 0, net.n - 1, nodes_out=nodes, edges_out=barred), flows.losses(net, 0, net.n - 1, flows.MaxFlowOptions(), nodes, barred)
        assert [e for e, _ in got] == [e for e, _ in want]
        assert all(abs(x - y) < 1e-9 for (_, x), (_, y) in zip(got, want))
    assert several > 50


def test_sensitivity_fills_no_more_than_the_edge_s_branch_again(monkeypatch):
    sizes, state = [], flows.State
    monkeypatch.setattr(flows, "State", lambda net, *rest: sizes.append(net.m) or state(net, *rest))
    net = Net.of(52, [(0, v, 1, 4.0) for v in range(1, 51)] + [(v, 51, 1, 4.0) for v in range(1, 51)])
    assert len(flows.sensitivity(net, 0, 51)) == 100
    assert sum(sizes) <= 50 * 3 * 2


def test_many_equal_paths_are_searched_once(monkeypatch):
    calls, search = [], paths.shortest_paths
    monkeypatch.setattr(paths, "shortest_paths", lambda *a, **k: calls.append(1) or search(*a, **k))
    net = Net.of(52, [(0, v, 1, 4.0) for v in range(1, 51)] + [(v, 51, 1, 4.0) for v in range(1, 51)])
    got = paths.k_shortest(net, 0, 51, 40)
    assert got == sorted(got) and len(got) == 40 and {c for c, _ in got} == {2}
    assert len(calls) <= 4
