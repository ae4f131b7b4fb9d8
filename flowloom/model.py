"""Constants, options and result records of the flow engine."""

from __future__ import annotations

import enum
from dataclasses import dataclass, field

# fixed values: thresholds that results depend on
MIN_CAP = 1.0 / 4096.0
MIN_FLOW = 1.0 / 4096.0
EPSILON = 1e-12


class FlowPlacement(enum.Enum):
    PROPORTIONAL = 1
    EQUAL_BALANCED = 2


class EdgeTieBreak(enum.Enum):
    DETERMINISTIC = 1
    PREFER_HIGHER_RESIDUAL = 2


class PathAlg(enum.Enum):
    SPF = 1


@dataclass(frozen=True)
class EdgeSelection:
    multi_edge: bool = True
    require_capacity: bool = False
    tie_break: EdgeTieBreak = EdgeTieBreak.DETERMINISTIC


@dataclass(frozen=True)
class SpfOptions:
    multipath: bool = True
    selection: EdgeSelection = field(default_factory=EdgeSelection)


@dataclass(frozen=True)
class KspOptions:
    k: int = 1
    max_cost_factor: float | None = None
    unique: bool = True


@dataclass(frozen=True)
class MaxFlowOptions:
    placement: FlowPlacement = FlowPlacement.PROPORTIONAL
    shortest_path: bool = False
    require_capacity: bool = True
    with_edge_flows: bool = False
    with_residuals: bool = False
    with_reachable: bool = False


@dataclass(frozen=True)
class FlowPolicyConfig:
    placement: FlowPlacement = FlowPlacement.PROPORTIONAL
    selection: EdgeSelection = field(default_factory=EdgeSelection)
    path_alg: PathAlg = PathAlg.SPF
    require_capacity: bool = True
    multipath: bool = True
    min_flow_count: int = 1
    max_flow_count: int | None = None
    max_path_cost: int | None = None
    max_path_cost_factor: float | None = None
    shortest_path: bool = False
    reoptimize_flows_on_each_placement: bool = False
    max_no_progress_iterations: int = 100
    max_total_iterations: int = 10000
    diminishing_returns_enabled: bool = True
    diminishing_returns_window: int = 8
    diminishing_returns_epsilon_frac: float = 1e-3
    excluded_nodes: frozenset[int] = frozenset()
    excluded_edges: frozenset[int] = frozenset()


@dataclass(frozen=True, order=True)
class FlowIndex:
    src: int
    dst: int
    flow_class: int
    flow_id: int


@dataclass
class FlowSummary:
    """min_cut lists edge ids; edge_flows, residuals and reachable only on request."""

    total_flow: float = 0.0
    cost_dist: list[tuple[int, float]] = field(default_factory=list)
    min_cut: list[int] = field(default_factory=list)
    edge_flows: list[float] = field(default_factory=list)
    residuals: list[float] = field(default_factory=list)
    reachable: list[bool] = field(default_factory=list)
