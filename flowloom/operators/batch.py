"""Batches of graph queries: one row a query, spread over tasks, one kernel call each.

A graph of up to LOCAL_EDGES edges travels as one broadcast of arrays and the
queries are dealt by a hash of query_id.  Of a larger one each pair of ends gets
the edges that its paths may use, found by joins and grouped with its queries, so
no process holds the graph; only where these parts together hold more than
PART_TIMES the edges of a graph that fits a process, it is broadcast all the
same.  Both ways give equal results.  Masks come as rows (scenario_id, node) and
(scenario_id, edge_id), gathered per scenario, and meet their queries by a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import graph as graphs
from ..functions import flows, paths, policy
from ..graph import Graph, Net, materialise
from ..model import MIN_CAP, EdgeSelection, FlowPlacement, FlowPolicyConfig, MaxFlowOptions
from . import frames

QUERY = ("query_id", "src", "dst", "nodes_out", "edges_out")
#: most edges of all parts together, as a multiple of the graph's, where the graph could also be broadcast
PART_TIMES = 8
#: queries of one pair of ends that a task takes in about one go
PART_QUERIES = 64
#: what a query's part of a large graph holds: paths between its ends, all paths from its source, or the whole
BETWEEN, FROM, WHOLE = ("p_src", "p_dst"), ("p_src",), ()
SUMMARY = (
    "query_id long, src int, dst int, total_flow double, cost_dist array<struct<cost:long,flow:double>>, "
    "min_cut array<int>, edge_flows array<double>, residuals array<double>, reachable array<boolean>"
)


def with_masks(queries: DataFrame, excluded_nodes: DataFrame | None = None, excluded_edges: DataFrame | None = None) -> DataFrame:
    """Queries plus nodes_out and edges_out; masks join on scenario_id."""
    none = F.expr("cast(array() AS array<int>)")
    for name, df, col in (("nodes_out", excluded_nodes, "node"), ("edges_out", excluded_edges, "edge_id")):
        if df is None:
            queries = queries.withColumn(name, none)
        else:
            lists = df.groupBy("scenario_id").agg(F.collect_set(F.col(col).cast("int")).alias(name))
            queries = queries.join(lists, "scenario_id", "left").withColumn(name, F.coalesce(name, none))
    return queries


def graph_parts(graph: Graph, keys: DataFrame, scope: tuple[str, ...]) -> DataFrame | None:
    """frames.parts of a large graph, or None where the whole graph is to be broadcast."""
    if graph.num_edges <= graphs.LOCAL_EDGES or not scope:
        return None
    found = frames.parts(graph.edges, keys, "p_dst" in scope)
    if graph.num_edges <= graphs.MAX_LOCAL_EDGES and found.count() > PART_TIMES * graph.num_edges:
        return None
    return found


def part_net(whole: int, table: pa.Table, ends) -> Net:
    if table.num_rows > graphs.MAX_LOCAL_EDGES:
        raise ValueError(f"the part of one query has {table.num_rows} edges, more than {graphs.MAX_LOCAL_EDGES}: use the DataFrame operators of flowloom.operators.frames")
    return Net.part(whole, *(table.column(c).to_numpy() for c in ("edge_id", "src", "dst", "capacity", "cost")), ends)


def part_rows(net: Net, table: pa.Table) -> Iterator[dict]:
    """The queries of a group in the ids of their part; masked ids outside it are left out."""
    lists = [c for c in ("nodes_out", "edges_out", "residual") if c in table.column_names]
    nodes, edges = {v: k for k, v in enumerate(net.node_ids)}, np.array(net.edge_ids, np.int64)
    known = {"nodes_out": np.array(net.node_ids, np.int64), "edges_out": edges}
    for i, row in enumerate(table.drop_columns(lists).to_pylist()):
        row["ends"] = row["src"], row["dst"]
        row["src"], row["dst"] = (nodes.get(v, -1) for v in row["ends"])
        for c in lists:
            ids = table.column(c)[i].values
            if c == "residual":
                row[c] = None if ids is None else ids.to_numpy(zero_copy_only=False)[edges].tolist()
            else:
                row[c] = [] if ids is None else np.flatnonzero(np.isin(known[c], ids.drop_null().to_numpy())).tolist()
        yield row


def run_queries(graph: Graph, queries: DataFrame, kernel: Callable, schema: str, scope: tuple[str, ...] = BETWEEN) -> DataFrame:
    """kernel(net, row) yields result tuples; row has QUERY, ends (src and dst as given) and any further columns.

    In a part of a graph a row's ids are the part's; kernels give the graph's
    ids back (net.node_ids, net.edge_ids).
    """
    for c in ("nodes_out", "edges_out"):
        if c not in queries.columns:
            queries = queries.withColumn(c, F.expr("cast(array() AS array<int>)"))
    names = [f.name for f in T._parse_datatype_string(schema)]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    keyed = queries.withColumn("p_src", F.col("src")).withColumn("p_dst", F.col("dst") if "p_dst" in scope else F.lit(0))
    many = graph.num_edges > graphs.LOCAL_EDGES and keyed.groupBy("p_src", "p_dst").count().agg(F.max("count")).first()[0] or 0
    keyed = keyed.withColumn("p_no", F.pmod(F.xxhash64("query_id"), F.lit(1 + many // PART_QUERIES)).cast("int"))
    group = ["p_src", "p_dst", "p_no"]
    found = graph_parts(graph, keyed.select(group).distinct(), scope)
    sc, whole = graph.spark.sparkContext, graph.num_nodes

    def columns(out: list[tuple]) -> list[pa.Array]:
        return [pa.array([r[k] for r in out], arrow.field(k).type) for k in range(len(names))]

    if found is not None:

        def run_group(edges: pa.Table, rows: pa.Table) -> pa.Table:
            net = part_net(whole, edges, rows.column("src").to_pylist() + rows.column("dst").to_pylist())
            out = [r for row in part_rows(net, rows.drop_columns(group)) for r in kernel(net, row)]
            return pa.Table.from_arrays(columns(out), schema=arrow)

        tasks = max(8 * sc.defaultParallelism, int(graph.spark.conf.get("spark.sql.shuffle.partitions")))
        found, keyed = found.repartition(tasks, *group), keyed.repartition(tasks, *group)
        return found.groupBy(*group).cogroup(keyed.groupBy(*group)).applyInArrow(run_group, schema)

    shared = sc.broadcast(graph.net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            out = [r for row in batch.to_pylist() for r in kernel(net, row | {"ends": (row["src"], row["dst"])})]
            for a in range(0, len(out), 5000):
                yield pa.RecordBatch.from_arrays(columns(out[a : a + 5000]), schema=arrow)

    return queries.repartition(sc.defaultParallelism, "query_id").mapInArrow(run, schema)


def tree_rows(net: Net, tree: paths.Dag, node: int) -> list[dict]:
    """The parents of a node in the graph's ids."""
    return [{"parent": net.node_ids[p], "edges": [net.edge_ids[x] for x in e]} for p, e in tree.parents.get(node, [])]


def spf(graph: Graph, queries: DataFrame, multipath: bool = True, selection: EdgeSelection = EdgeSelection(), to_dst: bool = False) -> DataFrame:
    """(query_id, node, dist, parents): parents is array<struct<parent, edges>> in settle order."""

    queries = checked_queries(graph, queries, need_dst=to_dst)

    def kernel(net, q):
        gate = paths.Gate(net, q.get("residual"), q["nodes_out"], q["edges_out"], selection.require_capacity)
        dist, tree = paths.shortest_paths(net, q["src"], q["dst"] if to_dst else None, gate, multipath, selection)
        for node in sorted(dist):
            yield q["query_id"], net.node_ids[node], dist[node], tree_rows(net, tree, node)

    return run_queries(graph, queries, kernel, "query_id long, node int, dist long, parents array<struct<parent:int,edges:array<int>>>", FROM)


def resolve_to_paths(graph: Graph, queries: DataFrame, split_parallel_edges: bool = False, max_paths: int | None = None, selection: EdgeSelection = EdgeSelection()) -> DataFrame:
    """(query_id, path_no, cost, hops): hops is array<struct<node, edges>>, the last one dst."""
    queries = checked_queries(graph, queries)

    def kernel(net, q):
        gate = paths.Gate(net, q.get("residual"), net.no_way_to(q["dst"]) | set(q["nodes_out"]), q["edges_out"], selection.require_capacity)
        dist, tree = paths.shortest_paths(net, q["src"], q["dst"], gate, True, selection)
        for k, path in enumerate(paths.resolve_paths(tree, q["src"], q["dst"], split_parallel_edges, max_paths)):
            yield q["query_id"], k, dist.get(q["dst"], 0), [{"node": net.node_ids[n], "edges": [net.edge_ids[x] for x in e]} for n, e in path]

    return run_queries(graph, queries, kernel, "query_id long, path_no int, cost long, hops array<struct<node:int,edges:array<int>>>")


def ksp(graph: Graph, queries: DataFrame, k: int, max_cost_factor: float | None = None, unique: bool = True) -> DataFrame:
    """(query_id, path_no, cost, edges) of up to k loop-free paths."""
    if k <= 0:
        raise ValueError("k must be positive")

    def kernel(net, q):
        for n, (cost, edges) in enumerate(paths.k_shortest(net, q["src"], q["dst"], k, max_cost_factor, unique, q["nodes_out"], q["edges_out"])):
            yield q["query_id"], n, cost, [net.edge_ids[e] for e in edges]

    return run_queries(graph, queries, kernel, "query_id long, path_no int, cost long, edges array<int>")


def ksp_dags(graph: Graph, queries: DataFrame, k: int, max_cost_factor: float | None = None, unique: bool = True) -> DataFrame:
    """(query_id, path_no, node, dist, parents): the distances and DAG of each of up to k paths."""
    if k <= 0:
        raise ValueError("k must be positive")

    def kernel(net, q):
        for n, (_, edges) in enumerate(paths.k_shortest(net, q["src"], q["dst"], k, max_cost_factor, unique, q["nodes_out"], q["edges_out"])):
            dist, tree = paths.path_dag(net, q["src"], edges)
            for node, d in dist.items():
                yield q["query_id"], n, net.node_ids[node], d, tree_rows(net, tree, node)

    return run_queries(graph, queries, kernel, "query_id long, path_no int, node int, dist long, parents array<struct<parent:int,edges:array<int>>>")


def checked_queries(graph: Graph, queries: DataFrame, need_dst: bool = True) -> DataFrame:
    """``queries``, or an error when a source, target or mask names what the graph has not.

    One aggregate over the query rows, which runs at once.  A target of -1
    stands for none where ``need_dst`` is off.
    """
    n, m = graph.num_nodes, graph.num_edges

    def outside(c, size, least=0):
        return c.isNull() | (c < least) | (c >= size)

    def any_outside(name, size):
        return F.exists(name, lambda x: outside(x, size))

    rules = {"src": outside(F.col("src"), n)}
    if "dst" in queries.columns:
        rules["dst"] = outside(F.col("dst"), n, 0 if need_dst else -1)
    for name, size in (("nodes_out", n), ("edges_out", m)):
        if name in queries.columns:
            rules[name] = any_outside(name, size)
    row = queries.agg(*[F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias(k) for k, c in rules.items()]).first()
    broken = {k: v for k, v in row.asDict().items() if v}
    if broken:
        raise ValueError(f"queries outside the graph of {n} nodes and {m} edges: {broken}")
    return queries


def max_flow(graph: Graph, queries: DataFrame, options: MaxFlowOptions = MaxFlowOptions()) -> DataFrame:
    """One summary row for each query (SUMMARY); bad pairs give zero summaries.

    A row with edge_flows or residuals is as long as the graph has edges, so
    these need a graph that fits a process; the operator edge_flows does not.
    """

    def kernel(net, q):
        s = flows.max_flow(net, q["src"], q["dst"], options, q["nodes_out"], q["edges_out"])
        near = np.zeros(net.whole if s.reachable else 0, bool)
        near[[net.node_ids[v] for v, on in enumerate(s.reachable) if on]] = True
        yield q["query_id"], *q["ends"], float(s.total_flow), [{"cost": c, "flow": f} for c, f in s.cost_dist], [net.edge_ids[e] for e in s.min_cut], s.edge_flows, s.residuals, near

    scope = WHOLE if options.with_edge_flows or options.with_residuals else BETWEEN
    if scope and graph.num_edges > graphs.LOCAL_EDGES and (options.with_reachable or not graph.edges.where(F.col("capacity") <= MIN_CAP).isEmpty()):
        scope = FROM  # nodes and closed edges that do not lead to the target count too
    return run_queries(graph, queries, kernel, SUMMARY, scope)


def sensitivity(graph: Graph, queries: DataFrame, options: MaxFlowOptions = MaxFlowOptions()) -> DataFrame:
    """(query_id, edge_id, loss) of the saturated edges whose removal loses flow."""

    def kernel(net, q):
        for e, lost in flows.sensitivity(net, q["src"], q["dst"], options, q["nodes_out"], q["edges_out"]):
            yield q["query_id"], net.edge_ids[e], float(lost)

    return run_queries(graph, queries, kernel, "query_id long, edge_id int, loss double")


def edge_flows(graph: Graph, queries: DataFrame, options: MaxFlowOptions = MaxFlowOptions()) -> DataFrame:
    """(query_id, edge_id, flow, residual) of the edges that carry flow."""

    def kernel(net, q):
        s = flows.max_flow(net, q["src"], q["dst"], replace(options, with_edge_flows=True, with_residuals=True), q["nodes_out"], q["edges_out"])
        for e, f in enumerate(s.edge_flows):
            if f > 0:
                yield q["query_id"], net.edge_ids[e], float(f), float(s.residuals[e])

    return run_queries(graph, queries, kernel, "query_id long, edge_id int, flow double, residual double")


def place_demands(graph: Graph, demands: DataFrame, config: FlowPolicyConfig = FlowPolicyConfig()) -> tuple[DataFrame, DataFrame]:
    """Places demands (scenario_id, demand_id, src, dst, flow_class, volume).

    The demands of a scenario share one ledger and go in the order of demand_id,
    in one group (one task for a scenario: each placement needs the one before);
    scenarios run in parallel.  The placement runs once and is written.  Returns (scenario_id, demand_id,
    placed, leftover, flow_count) and the ledger (scenario_id, src, dst,
    flow_class, flow_id, demand_id, edge_id, flow).
    """
    entry = pa.struct([("src", pa.int32()), ("dst", pa.int32()), ("flow_class", pa.int32()), ("flow_id", pa.int64()), ("edge_id", pa.int32()), ("flow", pa.float64())])
    types = {"scenario_id": pa.int64(), "demand_id": pa.int64(), "placed": pa.float64(), "leftover": pa.float64(), "flow_count": pa.int32(), "entries": pa.list_(entry)}

    def place(net: Net, table: pa.Table) -> pa.Table:
        nodes = {v: k for k, v in enumerate(net.node_ids)}
        barred = {e: k for k, e in enumerate(net.edge_ids)} if config.excluded_edges else {}
        own = replace(config, excluded_nodes=frozenset(nodes[v] for v in config.excluded_nodes if v in nodes), excluded_edges=frozenset(barred[e] for e in config.excluded_edges if e in barred))
        book, done, next_id = policy.FlowGraph(net), [], 0
        for d in sorted(table.to_pylist(), key=lambda d: d["demand_id"]):
            one = policy.FlowPolicy(net, own, first_id=next_id)
            done.append((d, one, one.place_demand(book, nodes.get(d["src"], -1), nodes.get(d["dst"], -1), d["flow_class"], d["volume"])))
            next_id = one.next_id
        rows = [
            (d["scenario_id"], d["demand_id"], float(got), float(left), len(one.flows), [{"src": d["src"], "dst": d["dst"], "flow_class": i.flow_class, "flow_id": i.flow_id, "edge_id": net.edge_ids[e], "flow": f} for i in sorted(one.flows) for e, f in book.flow_edges(i)])
            for d, one, (got, left) in done
        ]
        return pa.table({c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate(types.items())})

    schema = "scenario_id long, demand_id long, placed double, leftover double, flow_count int, entries array<struct<src:int,dst:int,flow_class:int,flow_id:long,edge_id:int,flow:double>>"
    keys = demands.select("scenario_id", F.col("src").alias("p_src"), F.col("dst").alias("p_dst")).distinct()
    found = graph_parts(graph, keys, BETWEEN)
    sc, whole = graph.spark.sparkContext, graph.num_nodes
    if found is None:
        shared = sc.broadcast(graph.net)
        placed = demands.groupBy("scenario_id").applyInArrow(lambda table: place(shared.value, table), schema)
    else:
        found = found.drop("p_src", "p_dst")
        if config.placement is FlowPlacement.EQUAL_BALANCED and config.max_flow_count is not None:  # its flows aim at a share of all room at the source
            at = materialise(keys.select("scenario_id", F.col("p_src").alias("src")).distinct())
            found = found.unionByName(graph.edges.drop("ext_edge_id").join(at, "src"))

        def place_part(edges: pa.Table, table: pa.Table) -> pa.Table:
            return place(part_net(whole, edges, table.column("src").to_pylist() + table.column("dst").to_pylist()), table)

        tasks = max(8 * sc.defaultParallelism, int(graph.spark.conf.get("spark.sql.shuffle.partitions")))
        found, rows = found.repartition(tasks, "scenario_id"), demands.repartition(tasks, "scenario_id")
        placed = found.groupBy("scenario_id").cogroup(rows.groupBy("scenario_id")).applyInArrow(place_part, schema)
    done = materialise(placed)
    ledger = done.select("scenario_id", "demand_id", F.explode("entries").alias("x")).select("scenario_id", "x.src", "x.dst", "x.flow_class", "x.flow_id", "demand_id", "x.edge_id", "x.flow")
    return done.drop("entries"), ledger
