"""Shortest paths, path listing and k shortest paths of one query."""

from __future__ import annotations

import heapq
import itertools
import math
from dataclasses import dataclass, field

from ..graph import Net
from ..model import EPSILON, MIN_CAP, EdgeSelection, EdgeTieBreak


@dataclass
class Dag:
    """parents[v]: (parent, edge ids) in the order in which parents settled."""

    parents: dict[int, list[tuple[int, list[int]]]] = field(default_factory=dict)

    def rows(self):
        for node in sorted(self.parents):
            place = 0
            for parent, edges in self.parents[node]:
                for e in edges:
                    yield node, parent, e, place
                    place += 1


class Gate:
    """Which nodes and edges a query may use, and what remains on an edge."""

    def __init__(self, net: Net, residual=None, nodes_out=(), edges_out=(), require_capacity: bool = False):
        self.rest = net.caps if residual is None else residual  # read only, never copied
        self.check = require_capacity or residual is not None
        self.nodes_out, self.edges_out = frozenset(nodes_out), frozenset(edges_out)

    def usable(self, edges: list[int]) -> list[int]:
        rest, out = self.rest, self.edges_out
        return [e for e in edges if e not in out and not (self.check and rest[e] < MIN_CAP)]


def pick(net: Net, gate: Gate, edges: list[int], selection: EdgeSelection) -> tuple[int, list[int]] | None:
    """(cost, edges) selected among the parallel edges of a pair, or None."""
    if len(edges) == 1:
        e = edges[0]
        return None if e in gate.edges_out or gate.check and gate.rest[e] < MIN_CAP else (net.costs[e], edges)
    edges = gate.usable(edges)
    if not edges:
        return None
    cost = min(net.costs[e] for e in edges)
    ties = [e for e in edges if net.costs[e] == cost]
    if selection.multi_edge:
        return cost, ties
    best = ties[0]
    if selection.tie_break is EdgeTieBreak.PREFER_HIGHER_RESIDUAL:
        for e in ties[1:]:
            if gate.rest[e] > gate.rest[best] + EPSILON:
                best = e
    return cost, [best]


def shortest_paths(net: Net, src: int, dst: int | None, gate: Gate, multipath: bool = True, selection: EdgeSelection = EdgeSelection(), widest: bool = True) -> tuple[dict[int, int], Dag]:
    """(distance of each reached node, predecessor DAG).

    With dst the search ends once nothing at dst's distance is open; distances
    beyond it are tentative.  A single path is the widest of the shortest ones,
    or with ``widest`` off the first one found.  A cycle of zero cost among the
    nodes that are reached raises, since they have no DAG.
    """
    dist: dict[int, int] = {}
    dag = Dag()
    if not 0 <= src < net.n or src in gate.nodes_out:
        return dist, dag
    dist[src] = 0
    width = {src: math.inf}
    heap = [(0, -math.inf, src)]
    done: set[int] = set()
    while heap:
        d, _, u = heapq.heappop(heap)
        if dst is not None and dst in dist and d > dist[dst]:
            break
        if d > dist[u] or u in done and multipath:
            continue
        done.add(u)
        if u == dst:
            continue
        for v, edges in net.out[u]:
            if v in gate.nodes_out:
                continue
            got = pick(net, gate, edges, selection)
            if got is None:
                continue
            there = d + got[0]
            wide = min(width[u], max(gate.rest[e] for e in got[1]))
            old = dist.get(v)
            if old is None or there < old or (there == old and not multipath and widest and v != src and wide > width[v] + EPSILON):
                dist[v], width[v] = there, wide
                dag.parents[v] = [(u, got[1])]
                heapq.heappush(heap, (there, -wide, v))
            elif there == old and multipath and v != src:
                dag.parents.setdefault(v, []).append((u, got[1]))
    if net.has_free_edges and cyclic(dag):
        raise ValueError("a cycle of zero cost has no shortest-path DAG")
    return dist, dag


def cyclic(dag: Dag) -> bool:
    """Whether following parents can come back."""
    waits = {v: len(p) for v, p in dag.parents.items()}
    after: dict[int, list[int]] = {}
    for v, p in dag.parents.items():
        for u, _ in p:
            after.setdefault(u, []).append(v)
    ready = [u for u in after if u not in waits]
    while ready:
        for v in after.get(ready.pop(), []):
            waits[v] -= 1
            if not waits[v]:
                ready.append(v)
    return any(waits.values())


def resolve_paths(dag: Dag, src: int, dst: int, split: bool = False, limit: int | None = None):
    """Paths as lists of (node, edge ids), the last one (dst, ()).

    split: one path for each choice of parallel edges, the last hop varying fastest.
    """
    if src == dst:
        return [[(src, ())]]
    if dst not in dag.parents or limit is not None and limit <= 0:
        return []
    out = []
    stack = [(dst, ())]
    while stack:
        node, tail = stack.pop()
        if node == src:
            hops = [(u, tuple(e)) for u, e in tail]
            choices = itertools.product(*[[(x,) for x in e] for _, e in hops]) if split else [tuple(e for _, e in hops)]
            for choice in choices:
                out.append([(u, e) for (u, _), e in zip(hops, choice)] + [(dst, ())])
                if limit is not None and len(out) >= limit:
                    return out
            continue
        merged: dict[int, list[int]] = {}
        for parent, edges in dag.parents.get(node, []):
            merged.setdefault(parent, []).extend(edges)
        for parent, edges in reversed(merged.items()):
            stack.append((parent, ((parent, edges), *tail)))
    return out


def k_shortest(net: Net, src: int, dst: int, k: int, factor: float | None = None, unique: bool = True, nodes_out=(), edges_out=()) -> list[tuple[int, list[int]]]:
    """Up to k loop-free paths as (cost, edge ids), by cost and then edge ids.

    Every equal-cost spur path of the last accepted path becomes a candidate.
    So all paths that cost as much as the last one are candidates already where
    parallel edges cost the same; once there are enough, no more is searched.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if src == dst or not (0 <= src < net.n and 0 <= dst < net.n):
        return []
    one = EdgeSelection(multi_edge=False)
    dist, dag = shortest_paths(net, src, dst, Gate(net, None, nodes_out, edges_out), multipath=False, selection=one, widest=False)
    if dst not in dist or dst in frozenset(nodes_out):
        return []
    first = resolve_paths(dag, src, dst)[0]
    ceiling = dist[dst] * factor if factor is not None and factor > 0 else math.inf
    if dist[dst] > ceiling:
        return []
    taken = [(dist[dst], [e[0] for _, e in first[:-1]])]
    closed = frozenset(nodes_out) | net.no_way_to(dst)
    waiting: list[tuple[int, list[int]]] = []
    seen = {tuple(taken[0][1])}
    while len(taken) < k:
        cost, edges = taken[-1]
        left = k - len(taken)
        if unique and len(waiting) >= left and net.even_pairs and sum(c == cost for c, _ in waiting) >= left:
            return taken + [heapq.heappop(waiting) for _ in range(left)]
        nodes = [src] + [int(net.dst[e]) for e in edges]
        spent = 0
        for i, spur in enumerate(nodes[:-1]):
            prefix = nodes[: i + 1]
            barred = {p[i] for _, p in taken if len(p) > i and [src] + [int(net.dst[e]) for e in p[:i]] == prefix}
            gate = Gate(net, None, closed | set(nodes[:i]), frozenset(edges_out) | barred)
            _, tree = shortest_paths(net, spur, dst, gate)
            for path in resolve_paths(tree, spur, dst, split=True):
                whole = edges[:i] + [e[0] for _, e in path[:-1]]
                total = spent + sum(net.costs[e] for e in whole[i:])
                if total > ceiling or unique and tuple(whole) in seen:
                    continue
                seen.add(tuple(whole))
                heapq.heappush(waiting, (total, whole))
            spent += net.costs[edges[i]]
        if not waiting:
            break
        taken.append(heapq.heappop(waiting))
    return taken


def path_dag(net: Net, src: int, edges: list[int]) -> tuple[dict[int, int], Dag]:
    """Distances along one path and the DAG that holds it alone."""
    dist, dag, at = {src: 0}, Dag(), src
    for e in edges:
        to = int(net.dst[e])
        dist[to] = dist[at] + net.costs[e]
        dag.parents[to] = [(at, [e])]
        at = to
    return dist, dag
