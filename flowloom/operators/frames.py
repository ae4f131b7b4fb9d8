"""Relational operators for graphs of any size: loops of joins and aggregates.

Each loop advances all queries together; a round joins the changed rows alone
with the edges and materialises its result, so that plans stay short and a lost
executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..graph import Graph, materialise
from ..model import MIN_CAP, MIN_FLOW


def allowed(edges: DataFrame, excluded_nodes: DataFrame | None = None, excluded_edges: DataFrame | None = None, residual: DataFrame | None = None, require_capacity: bool = False) -> DataFrame:
    """Edges after masks and the capacity gate, with column rest."""
    e = edges.withColumn("rest", F.col("capacity"))
    if residual is not None:
        e = edges.join(residual.select("edge_id", F.col("residual").alias("rest")), "edge_id")
    if excluded_nodes is not None:
        for end in ("src", "dst"):
            e = e.join(excluded_nodes.select(F.col("node").alias(end)).distinct(), end, "left_anti")
    if excluded_edges is not None:
        e = e.join(excluded_edges.select("edge_id").distinct(), "edge_id", "left_anti")
    return e.where(F.col("rest") >= MIN_CAP) if require_capacity or residual is not None else e


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, node, dist) for sources (query_id, src): repeated relaxation."""
    hops = edges.where("src <> dst").groupBy("src", "dst").agg(F.min("cost").alias("cost"))
    hops = materialise(hops)
    known = materialise(sources.select("query_id", F.col("src").alias("node"), F.lit(0).cast("long").alias("dist")))
    frontier = known
    while True:
        step = frontier.join(hops, frontier.node == hops.src).groupBy("query_id", F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col("cost")).alias("new"))
        better = step.join(known, ["query_id", "node"], "left").where("dist IS NULL OR new < dist").select("query_id", "node", F.col("new").alias("dist"))
        frontier = materialise(better)
        if frontier.isEmpty():
            return known
        known = materialise(known.unionByName(frontier).groupBy("query_id", "node").agg(F.min("dist").alias("dist")))


def dag(edges: DataFrame, dist: DataFrame, multi_edge: bool = True, prefer_residual: bool = False) -> DataFrame:
    """(query_id, node, parent, edge_id): edges on shortest paths.

    Self-loops and edges back into the source never qualify, since costs on
    cycles are positive.  multi_edge false: one edge for each pair, the smallest
    id or, with prefer_residual, the one with most rest.
    """
    a = dist.select("query_id", F.col("node").alias("src"), F.col("dist").alias("d0"))
    b = dist.select("query_id", F.col("node").alias("dst"), F.col("dist").alias("d1"))
    on = edges.where("src <> dst").join(a, "src").join(b, ["query_id", "dst"]).where("d0 + cost = d1")
    if not multi_edge:
        by = [F.col("rest").desc()] if prefer_residual else []
        on = on.withColumn("k", F.row_number().over(W.partitionBy("query_id", "src", "dst").orderBy(*by, "edge_id"))).where("k = 1")
    return on.select("query_id", F.col("dst").alias("node"), F.col("src").alias("parent"), "edge_id")


def list_paths(tree: DataFrame, targets: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(query_id, edges) of all paths to targets (query_id, src, dst), parallel edges split.

    Goes on until every path has ended; max_hops: raise when a path has more edges.
    """
    open_ = targets.select("query_id", "src", F.col("dst").alias("at"), F.expr("cast(array() AS array<int>)").alias("edges"))
    done = None
    hops = 0
    while True:
        ended = open_.where("at = src").select("query_id", "edges")
        done = ended if done is None else done.unionByName(ended)
        go = open_.where("at <> src").join(tree.withColumnRenamed("node", "at"), ["query_id", "at"])
        open_ = materialise(go.select("query_id", "src", F.col("parent").alias("at"), F.concat(F.array("edge_id"), "edges").alias("edges")))
        if open_.isEmpty():
            return done
        hops += 1
        if max_hops is not None and hops > max_hops:
            raise ValueError(f"a path has more than {max_hops} edges")


def reachable(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, node) reached over arcs (query_id, u, v), or (u, v) for arcs that all queries share."""
    on = [c for c in ("query_id", "u") if c in arcs.columns]
    known = materialise(sources.select("query_id", F.col("src").alias("node")).distinct())
    frontier = known
    while True:
        step = frontier.withColumnRenamed("node", "u").join(arcs, on).select("query_id", F.col("v").alias("node")).distinct()
        frontier = materialise(step.join(known, ["query_id", "node"], "left_anti"))
        if frontier.isEmpty():
            return known
        known = materialise(known.unionByName(frontier))


def parts(edges: DataFrame, keys: DataFrame, to_dst: bool = True) -> DataFrame:
    """The columns of ``keys`` (p_src, p_dst and any more) with each edge that a path from p_src to p_dst may use.

    Without to_dst: each edge that a path from p_src may use.  What a cycle
    through the source or target adds stays in.
    """
    edges, keys = edges.select("edge_id", "src", "dst", "capacity", "cost"), materialise(keys)
    arcs = materialise(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct())
    starts = reachable(arcs, keys.select(F.col("p_src").alias("query_id"), F.col("p_src").alias("src")))
    found = edges.join(starts.select(F.col("query_id").alias("p_src"), F.col("node").alias("src")), "src")
    if not to_dst:
        return found.join(keys, "p_src")
    back = arcs.select(F.col("v").alias("u"), F.col("u").alias("v"))
    ends = reachable(back, keys.select(F.col("p_dst").alias("query_id"), F.col("p_dst").alias("src")))
    return found.join(ends.select(F.col("query_id").alias("p_dst"), F.col("node").alias("dst")), "dst").join(keys, ["p_src", "p_dst"])


def min_cut(edges: DataFrame, state: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, edge_id) of the cut; state: (query_id, edge_id, residual)."""
    full = materialise(state.join(edges, "edge_id"))
    ahead = full.where(F.col("residual") > MIN_CAP).select("query_id", F.col("src").alias("u"), F.col("dst").alias("v"))
    back = full.where(F.col("capacity") - F.col("residual") > MIN_FLOW).select("query_id", F.col("dst").alias("u"), F.col("src").alias("v"))
    near = reachable(ahead.unionByName(back).distinct(), sources)
    left = full.where(F.col("residual") <= MIN_CAP).join(near.withColumnRenamed("node", "src"), ["query_id", "src"], "left_semi")
    return left.join(near.withColumnRenamed("node", "dst"), ["query_id", "dst"], "left_anti").select("query_id", "edge_id")


def equal_balanced(tree: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, total): one even split over each query's DAG, by rounds of mass."""
    t = targets.select("query_id", "src", "dst")
    need = materialise(t.select("query_id", F.col("dst").alias("node")))
    up = tree.select("query_id", F.col("parent").alias("u"), "node", "edge_id")
    useful = reachable(up.select("query_id", F.col("node").alias("u"), F.col("u").alias("v")).distinct(), t.select("query_id", F.col("dst").alias("src")))
    live = up.join(useful, ["query_id", "node"], "left_semi").join(edges.select("edge_id", "rest"), "edge_id").where(F.col("rest") >= MIN_CAP)
    groups = live.groupBy("query_id", "u", "node").agg(F.count("*").alias("n"), F.min("rest").alias("low"))
    outs = groups.groupBy("query_id", "u").agg(F.sum("n").alias("outs"))
    groups = materialise(groups.join(outs, ["query_id", "u"]))
    mass = materialise(t.select("query_id", F.col("src").alias("u"), F.lit(1.0).alias("mass")))
    shares = None
    while True:
        moved = materialise(mass.join(groups, ["query_id", "u"]).select("query_id", "u", "node", "n", "low", (F.col("mass") * F.col("n") / F.col("outs")).alias("share")))
        if moved.isEmpty():
            break
        shares = moved if shares is None else shares.unionByName(moved)
        mass = materialise(moved.groupBy("query_id", F.col("node").alias("u")).agg(F.sum("share").alias("mass")))
    if shares is None:
        return t.select("query_id", F.lit(0.0).alias("total"))
    whole = shares.groupBy("query_id", "u", "node").agg(F.sum("share").alias("share"), F.first("n").alias("n"), F.first("low").alias("low"))
    scale = whole.groupBy("query_id").agg(F.min(F.col("low") * F.col("n") / F.col("share")).alias("scale"))
    arrives = whole.join(need, ["query_id", "node"], "left_semi").select("query_id").distinct()
    got = scale.join(arrives, "query_id", "left_semi")
    return t.join(got, "query_id", "left").select("query_id", F.when(F.col("scale") >= MIN_FLOW, F.col("scale")).otherwise(0.0).alias("total"))


def ledger_total(ledger: DataFrame) -> DataFrame:
    """(edge_id, flow) held by all flows of a ledger (src, dst, flow_class, flow_id, edge_id, flow)."""
    return ledger.groupBy("edge_id").agg(F.sum("flow").alias("flow"))


def ledger_residual(graph: Graph, ledger: DataFrame) -> DataFrame:
    """(edge_id, residual) of a graph under a ledger, flows clamped to 0..capacity."""
    held = graph.edges.select("edge_id", "capacity").join(ledger_total(ledger), "edge_id", "left")
    flow = F.least(F.greatest(F.coalesce("flow", F.lit(0.0)), F.lit(0.0)), F.col("capacity"))
    return held.select("edge_id", (F.col("capacity") - flow).alias("residual"))


def remove_by_class(ledger: DataFrame, flow_class: int) -> DataFrame:
    return ledger.where(F.col("flow_class") != flow_class)
