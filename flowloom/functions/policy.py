"""Flow ledger and demand placement."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, replace

from ..graph import Net
from ..model import MIN_FLOW, FlowIndex, FlowPlacement, FlowPolicyConfig, PathAlg
from .flows import State
from .paths import Dag, Gate, shortest_paths

#: most rebalances of one placement, each over what the one before placed; the last one's flows stay as they are
MAX_REBALANCE = 8
#: fixed value: parts of a flow below this are no part of its path
PATH_LEAST = 1e-12


class FlowGraph:
    """A state plus a ledger of what each flow holds on which edge."""

    def __init__(self, net: Net):
        self.net, self.state = net, State(net)
        self.ledger: dict[FlowIndex, dict[int, float]] = {}

    def place(self, index: FlowIndex, src: int, dst: int, dag: Dag, amount: float, placement: FlowPlacement) -> float:
        if amount <= 0:
            return 0.0
        trace: list[tuple[int, float]] = []
        placed = self.state.place(src, dst, dag, amount, placement, trace)
        held = self.ledger.setdefault(index, {})
        for e, part in trace:
            held[e] = held.get(e, 0.0) + part
        for e in [e for e, part in held.items() if part <= 0]:
            del held[e]
        if not held:
            del self.ledger[index]
        return placed

    def remove(self, index: FlowIndex) -> None:
        held = self.ledger.pop(index, None)
        if held:
            self.state.apply(held.items(), add=False)

    def remove_by_class(self, flow_class: int) -> None:
        for index in [i for i in self.ledger if i.flow_class == flow_class]:
            self.remove(index)

    def reset(self) -> None:
        self.state.reset()
        self.ledger.clear()

    def flow_edges(self, index: FlowIndex) -> list[tuple[int, float]]:
        return sorted(self.ledger.get(index, {}).items())

    def flow_path(self, index: FlowIndex) -> list[int]:
        """The flow's edges in order if they form one simple path, else []."""
        edges = [e for e, part in self.flow_edges(index) if part > PATH_LEAST]
        step: dict[int, int] = {}
        for e in edges:
            u = int(self.net.src[e])
            if u in step:
                return []
            step[u] = e
        out, at, seen = [], index.src, set()
        while at in step and at not in seen:
            seen.add(at)
            out.append(step[at])
            at = int(self.net.dst[step[at]])
        return out if len(out) == len(edges) and at == index.dst else []


@dataclass
class Flow:
    index: FlowIndex
    src: int
    dst: int
    dag: Dag
    cost: int
    placed: float = 0.0


class FlowPolicy:
    """Places one demand as flows on a shared FlowGraph, by its configuration."""

    def __init__(self, net: Net, config: FlowPolicyConfig = FlowPolicyConfig(), first_id: int = 0):
        self.net, self.config = net, config
        self.flows: dict[FlowIndex, Flow] = {}
        self.best_cost: int | None = None
        self.next_id = first_id
        self.static: list[tuple[int, int, Dag, int]] = []

    @property
    def placed_demand(self) -> float:
        return sum(f.placed for f in self.flows.values())

    def set_static_paths(self, paths: list[tuple[int, int, Dag, int]]) -> None:
        """(src, dst, DAG, cost) to use in place of searched paths."""
        if self.config.max_flow_count is not None and len(paths) != self.config.max_flow_count:
            raise ValueError("max_flow_count differs from the number of static paths")
        self.static = list(paths)

    def _paths(self, graph: FlowGraph, src: int, dst: int, min_flow: float | None) -> tuple[Dag, int] | None:
        c = self.config
        for s, d, dag, cost in self.static:
            if (s, d) == (src, dst):
                return dag, cost
        if self.static or c.path_alg is not PathAlg.SPF:
            return None
        even = c.placement is FlowPlacement.EQUAL_BALANCED
        selection = c.selection
        if not c.multipath:
            selection = replace(selection, multi_edge=False)
        elif even:
            selection = replace(selection, multi_edge=True)
        selection = replace(selection, require_capacity=selection.require_capacity or c.require_capacity)
        rest = graph.state.rest
        aware = c.require_capacity or (even and min_flow is not None)
        barred = set(c.excluded_edges)
        if aware and min_flow is not None and not even:
            barred |= {e for e, r in enumerate(rest) if r < min_flow}
        gate = Gate(self.net, rest if aware else None, c.excluded_nodes, barred, selection.require_capacity)
        dist, dag = shortest_paths(self.net, src, dst, gate, c.multipath, selection)
        if dst not in dag.parents:
            return None
        cost = dist[dst]
        if self.best_cost is None or cost < self.best_cost:
            self.best_cost = cost
        if c.shortest_path and cost > self.best_cost:
            return None
        if c.max_path_cost is not None or c.max_path_cost_factor is not None:
            factor = 1.0 if c.max_path_cost_factor is None else c.max_path_cost_factor
            if cost > min(math.inf if c.max_path_cost is None else c.max_path_cost, int(self.best_cost * factor)):
                return None
        return dag, cost

    def _create(self, graph: FlowGraph, src: int, dst: int, flow_class: int, min_flow: float | None = None) -> Flow | None:
        index = FlowIndex(src, dst, flow_class, self.next_id)
        self.next_id += 1  # an id is used up even if no path is found
        got = self._paths(graph, src, dst, min_flow)
        if got is None:
            return None
        flow = self.flows[index] = Flow(index, src, dst, *got)
        return flow

    def _reoptimize(self, graph: FlowGraph, flow: Flow, headroom: float) -> bool:
        """Moves a flow to a path with room for it and headroom; keeps it where there is none."""
        want = flow.placed
        graph.remove(flow.index)
        got = self._paths(graph, flow.src, flow.dst, want + headroom)
        if got is not None:
            flow.dag, flow.cost = got
        flow.placed = graph.place(flow.index, flow.src, flow.dst, flow.dag, want, self.config.placement)
        return got is not None

    @property
    def _even(self) -> bool:
        return self.config.placement is FlowPlacement.EQUAL_BALANCED

    @property
    def _bounded(self) -> bool:
        """Even flows of a fixed number: each aims at its share of the volume."""
        return self._even and self.config.max_flow_count is not None

    def _share(self, graph: FlowGraph, src: int, target: float) -> float:
        """What one flow aims at: a bounded one at its part of the target and of the room at the source."""
        if not self._bounded:
            return target
        room = sum(graph.state.rest[e] for _, edges in self.net.out[src] for e in edges) if 0 <= src < self.net.n else 0.0
        return max(MIN_FLOW, min(target, room) / self.config.max_flow_count)

    def _seed(self, graph: FlowGraph, src: int, dst: int, flow_class: int, min_flow: float | None) -> None:
        """The first flows: one for each static path, else min_flow_count."""
        if any((s, d) != (src, dst) for s, d, _, _ in self.static):
            raise ValueError("a static path leads elsewhere")
        if self.static and self.config.max_flow_count not in (None, len(self.static)):
            raise ValueError("max_flow_count differs from the number of static paths")
        least, most = self.config.min_flow_count, self.config.max_flow_count
        for _ in range(len(self.static) or (least if most is None else min(least, most))):
            self._create(graph, src, dst, flow_class, None if self.static else min_flow)

    def _room_for_more(self) -> bool:
        return self.config.max_flow_count is None or len(self.flows) < self.config.max_flow_count

    def _follow(self, graph: FlowGraph, flow: Flow, flow_class: int, target: float, share: float) -> Flow | None:
        """The flow that goes on after ``flow``: a new one, or itself on another path."""
        if self._even:
            return self._create(graph, flow.src, flow.dst, flow_class, share) if self._bounded and self._room_for_more() else None
        if target - flow.placed < MIN_FLOW:
            return None
        if self._room_for_more():
            return self._create(graph, flow.src, flow.dst, flow_class)
        return flow if self._reoptimize(graph, flow, MIN_FLOW) else None

    def _fill(self, graph: FlowGraph, flow_class: int, volume: float, target: float, share: float, fixed: bool) -> float:
        """Takes flows in turn until nothing more can be placed; what is left of the volume."""
        c, asked = self.config, volume
        queue = deque(self.flows[i] for i in sorted(self.flows))
        recent: deque[float] = deque(maxlen=c.diminishing_returns_window)
        idle = rounds = 0
        while volume >= MIN_FLOW and queue and (not rounds or rounds < c.max_total_iterations):
            flow = queue.popleft()
            if self._even and not self.static:
                found = self._paths(graph, flow.src, flow.dst, share)
                if found is not None:
                    flow.dag, flow.cost = found
            aim = target if fixed else share
            need = max(0.0, aim - flow.placed) if fixed or self._bounded else target
            got = graph.place(flow.index, flow.src, flow.dst, flow.dag, min(need, volume), c.placement)
            flow.placed += got
            volume -= got
            rounds += 1
            if c.shortest_path:
                break
            recent.append(got)
            if c.diminishing_returns_enabled and len(recent) == c.diminishing_returns_window and sum(recent) < max(MIN_FLOW, c.diminishing_returns_epsilon_frac * asked):
                break
            idle = idle + 1 if got < MIN_FLOW else 0
            if idle >= c.max_no_progress_iterations:
                break
            after = self._follow(graph, flow, flow_class, target, share)
            if after is not None:
                queue.append(after)
        return volume

    def _pass(self, graph: FlowGraph, src: int, dst: int, flow_class: int, volume: float, target_per_flow: float | None, min_flow: float | None, reoptimize: bool) -> float:
        """One placement without rebalancing; what is left of the volume."""
        target = volume if target_per_flow is None else target_per_flow
        share = self._share(graph, src, target)
        if not self.flows:
            self._seed(graph, src, dst, flow_class, share if self._bounded else min_flow)
        left = self._fill(graph, flow_class, volume, target, share, target_per_flow is not None)
        if reoptimize:
            for i in sorted(self.flows):
                self._reoptimize(graph, self.flows[i], MIN_FLOW)
        return left

    def place_demand(self, graph: FlowGraph, src: int, dst: int, flow_class: int, volume: float, target_per_flow: float | None = None, min_flow: float | None = None) -> tuple[float, float]:
        """(placed, left over) of a demand.

        Flows of even placement that differ from their mean are taken away and
        placed again, each up to the mean, without reoptimisation, until they
        are equal or MAX_REBALANCE times.
        """
        before = self.placed_demand
        left = self._pass(graph, src, dst, flow_class, volume, target_per_flow, min_flow, self.config.reoptimize_flows_on_each_placement)
        rebalanced = False
        for _ in range(MAX_REBALANCE if self._even and self.flows else 0):
            mean = self.placed_demand / len(self.flows) if self.flows else 0.0
            if all(abs(mean - f.placed) < MIN_FLOW for f in self.flows.values()):
                break
            again = self.placed_demand
            self.remove_demand(graph)
            left += self._pass(graph, src, dst, flow_class, again, mean, None, False)
            rebalanced = True
        return (self.placed_demand if rebalanced else self.placed_demand - before), left

    def rebalance_demand(self, graph: FlowGraph, src: int, dst: int, flow_class: int, target_per_flow: float) -> tuple[float, float]:
        volume = self.placed_demand
        self.remove_demand(graph)
        return self.place_demand(graph, src, dst, flow_class, volume, target_per_flow)

    def remove_demand(self, graph: FlowGraph) -> None:
        for i in sorted(self.flows):
            graph.remove(i)
        self.flows.clear()
        self.best_cost = None
