"""One handle for a graph's algorithms: checks its arguments, then calls the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .graph import Graph
from .model import EdgeSelection, FlowPolicyConfig, MaxFlowOptions
from .operators import batch
from .profiling import PROFILER, Profiler


class Algorithms:
    """Queries are rows (query_id, src, dst) with optional nodes_out and edges_out.

    Each call checks the query rows at once (an error names the column) and
    returns a DataFrame that runs when it is read.  With the profiler on,
    scopes hold the driver's time, and with ``timed`` that of a whole write.
    """

    def __init__(self, graph: Graph, profiler: Profiler = PROFILER):
        self.graph, self.profiler = graph, profiler

    def _run(self, name: str, operator, queries: DataFrame, *args, need_dst: bool = True, **options) -> DataFrame:
        with self.profiler.scope(name):
            return operator(self.graph, batch.checked_queries(self.graph, queries, need_dst), *args, **options)

    def shortest_paths(self, queries: DataFrame, multipath: bool = True, selection: EdgeSelection = EdgeSelection(), to_dst: bool = False) -> DataFrame:
        return self._run("shortest_paths", batch.spf, queries, multipath, selection, to_dst, need_dst=to_dst)

    def resolve_to_paths(self, queries: DataFrame, split_parallel_edges: bool = False, max_paths: int | None = None, selection: EdgeSelection = EdgeSelection()) -> DataFrame:
        return self._run("resolve_to_paths", batch.resolve_to_paths, queries, split_parallel_edges, max_paths, selection)

    def k_shortest_paths(self, queries: DataFrame, k: int, max_cost_factor: float | None = None, unique: bool = True, dags: bool = False) -> DataFrame:
        return self._run("k_shortest_paths", batch.ksp_dags if dags else batch.ksp, queries, k, max_cost_factor, unique)

    def max_flow(self, queries: DataFrame, options: MaxFlowOptions = MaxFlowOptions()) -> DataFrame:
        return self._run("max_flow", batch.max_flow, queries, options)

    def edge_flows(self, queries: DataFrame, options: MaxFlowOptions = MaxFlowOptions()) -> DataFrame:
        return self._run("edge_flows", batch.edge_flows, queries, options)

    def sensitivity(self, queries: DataFrame, options: MaxFlowOptions = MaxFlowOptions()) -> DataFrame:
        return self._run("sensitivity", batch.sensitivity, queries, options)

    def place_demands(self, demands: DataFrame, config: FlowPolicyConfig = FlowPolicyConfig()) -> tuple[DataFrame, DataFrame]:
        batch.checked_queries(self.graph, demands)
        with self.profiler.scope("place_demands"):
            return batch.place_demands(self.graph, demands, config)

    def timed(self, name: str, df: DataFrame) -> None:
        """Runs ``df`` to its end without keeping its rows."""
        with self.profiler.scope(name):
            df.write.format("noop").mode("overwrite").save()
