"""Graphs: an edge table with dense ids, its checks, and the compact form that kernels use."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EDGE_SCHEMA = "edge_id int, ext_edge_id long, src int, dst int, capacity double, cost long"
#: edges that may be held in one process: 28 bytes each in the broadcast, about 300 in a worker's lists, so
#: 1.2 GB at most
MAX_LOCAL_EDGES = 4_000_000
#: edges up to which every worker gets the whole graph; beyond, a query gets the part that it needs
LOCAL_EDGES = 1_000_000


def materialise(df: DataFrame) -> DataFrame:
    """Writes df into the cluster's shared folder and reads it back."""
    spark: SparkSession = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="flowloom-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Net:
    """A graph in arrays, edges in id order; built from sorted columns.

    A part of a graph numbers its nodes and edges anew in the same order;
    node_ids and edge_ids hold the graph's own ids, whole its number of nodes.
    """

    def __init__(self, num_nodes: int, src, dst, capacity, cost, ext=None):
        self.n = int(num_nodes)
        self.src, self.dst = np.asarray(src, np.int32), np.asarray(dst, np.int32)
        self.cap, self.cost = np.asarray(capacity, np.float64), np.asarray(cost, np.int64)
        self.ext = np.asarray(ext, np.int64) if ext is not None else np.arange(self.src.size, dtype=np.int64)
        self.m = self.src.size
        self.node_ids, self.edge_ids, self.whole = range(self.n), range(self.m), self.n

    @classmethod
    def part(cls, whole: int, edge_ids, src, dst, capacity, cost, ends=()) -> Net:
        """Some edges of a graph of ``whole`` nodes, in any order and possibly repeated, and the nodes ``ends``."""
        ids, first = np.unique(np.asarray(edge_ids, np.int64), return_index=True)
        src, dst, capacity, cost = (np.asarray(x)[first] for x in (src, dst, capacity, cost))
        nodes = np.unique(np.concatenate([src, dst, [v for v in ends if v is not None and 0 <= v < whole]]).astype(np.int64))
        net = cls(nodes.size, np.searchsorted(nodes, src), np.searchsorted(nodes, dst), capacity, cost)
        net.node_ids, net.edge_ids, net.whole = nodes.tolist(), ids.tolist(), whole
        return net

    @classmethod
    def of(cls, num_nodes: int, edges) -> Net:
        """From (src, dst, cost, capacity) tuples in any order."""
        rows = sorted(((c, s, d, i, cap) for i, (s, d, c, cap) in enumerate(edges)))
        checked(num_nodes, [r[1] for r in rows], [r[2] for r in rows], [r[4] for r in rows], [r[0] for r in rows])
        return cls(num_nodes, [r[1] for r in rows], [r[2] for r in rows], [r[4] for r in rows], [r[0] for r in rows], [r[3] for r in rows])

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("n", "src", "dst", "cap", "cost", "ext", "m", "node_ids", "edge_ids", "whole")}

    @cached_property
    def out(self) -> list[list[tuple[int, list[int]]]]:
        """Per node: (neighbour, edge ids) in the order of the first edge id."""
        table: list[dict[int, list[int]]] = [{} for _ in range(self.n)]
        for e, (u, v) in enumerate(zip(self.src.tolist(), self.dst.tolist())):
            table[u].setdefault(v, []).append(e)
        return [list(t.items()) for t in table]

    @cached_property
    def into(self) -> list[list[int]]:
        """Per node: the edges that end there."""
        table: list[list[int]] = [[] for _ in range(self.n)]
        for e, v in enumerate(self.dst.tolist()):
            table[v].append(e)
        return table

    @cached_property
    def costs(self) -> list[int]:
        return self.cost.tolist()

    @cached_property
    def caps(self) -> list[float]:
        return self.cap.tolist()

    def no_way_to(self, dst: int) -> frozenset[int]:
        """The nodes without any path to dst: a search for dst may leave them out.

        The last 64 targets are remembered.
        """
        known = self.__dict__.setdefault("_no_way", {})
        if dst not in known:
            if len(known) >= 64:
                known.pop(next(iter(known)))
            near, queue, src = {dst}, [dst], self.sources
            while queue:
                for e in self.into[queue.pop()]:
                    if src[e] not in near:
                        near.add(src[e])
                        queue.append(src[e])
            known[dst] = frozenset(range(self.n)) - near
        return known[dst]

    @cached_property
    def sources(self) -> list[int]:
        return self.src.tolist()

    @cached_property
    def even_pairs(self) -> bool:
        """Whether parallel edges cost the same and no edge is free."""
        return not self.has_free_edges and all(self.costs[e] == self.costs[edges[0]] for near in self.out for _, edges in near for e in edges)

    @cached_property
    def has_free_edges(self) -> bool:
        return bool((self.cost == 0).any())


def checked(num_nodes: int, src, dst, capacity, cost) -> None:
    if num_nodes < 0:
        raise ValueError("num_nodes must not be negative")
    if len({len(src), len(dst), len(capacity), len(cost)}) > 1:
        raise ValueError("edge columns differ in length")
    for name, ids in (("src", src), ("dst", dst)):
        if len(ids) and (min(ids) < 0 or max(ids) >= num_nodes):
            raise ValueError(f"{name} holds a node outside 0..{num_nodes - 1}")
    if any(c < 0 for c in capacity) or any(c < 0 for c in cost):
        raise ValueError("capacity and cost must not be negative")


@dataclass
class Graph:
    """edges: EDGE_SCHEMA; edge_id is the rank by (cost, src, dst, ext_edge_id)."""

    edges: DataFrame
    num_nodes: int

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @cached_property
    def num_edges(self) -> int:
        return self.edges.count()

    @cached_property
    def net(self) -> Net:
        """The arrays, for graphs of a checked size."""
        if self.num_edges > MAX_LOCAL_EDGES:
            raise ValueError(f"{self.num_edges} edges exceed {MAX_LOCAL_EDGES}: use the DataFrame operators of flowloom.operators.frames")
        t = self.edges.orderBy("edge_id").toArrow()
        return Net(self.num_nodes, *(t.column(c).to_numpy() for c in ("src", "dst", "capacity", "cost", "ext_edge_id")))

    def nodes(self) -> DataFrame:
        return self.spark.range(self.num_nodes).select(F.col("id").cast("int").alias("node"))

    def degrees(self) -> DataFrame:
        """(node, out_degree, in_degree, out_offset, in_offset): the compressed-row offsets.

        Offsets come from a running sum over nodes, range-partitioned by a block
        of nodes, so no task holds all nodes.
        """
        outs = self.edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
        ins = self.edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
        both = self.nodes().join(outs, "node", "left").join(ins, "node", "left").na.fill(0, ["out_degree", "in_degree"])
        both = both.withColumn("block", F.floor(F.col("node") / 65536))
        blocks = both.groupBy("block").agg(F.sum("out_degree").alias("o"), F.sum("in_degree").alias("i"))
        ahead = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # one row for every 65,536 nodes
        blocks = blocks.select("block", F.coalesce(F.sum("o").over(ahead), F.lit(0)).alias("o0"), F.coalesce(F.sum("i").over(ahead), F.lit(0)).alias("i0"))
        inner = W.partitionBy("block").orderBy("node").rowsBetween(W.unboundedPreceding, -1)
        return both.join(blocks, "block").select(
            "node",
            "out_degree",
            "in_degree",
            (F.col("o0") + F.coalesce(F.sum("out_degree").over(inner), F.lit(0))).alias("out_offset"),
            (F.col("i0") + F.coalesce(F.sum("in_degree").over(inner), F.lit(0))).alias("in_offset"),
        )

    def adjacency(self, reverse: bool = False) -> DataFrame:
        """(node, neighbour, edge_id) rows; ordered by edge_id within a node."""
        a, b = ("dst", "src") if reverse else ("src", "dst")
        return self.edges.select(F.col(a).alias("node"), F.col(b).alias("neighbour"), "edge_id")


def violations(edges: DataFrame, num_nodes: int) -> dict[str, int]:
    """Counts of rows that break a rule, in one pass."""
    bad = {
        "null": F.col("src").isNull() | F.col("dst").isNull() | F.col("capacity").isNull() | F.col("cost").isNull(),
        "src": (F.col("src") < 0) | (F.col("src") >= num_nodes),
        "dst": (F.col("dst") < 0) | (F.col("dst") >= num_nodes),
        "capacity": F.col("capacity") < 0,
        "cost": F.col("cost") < 0,
    }
    row = edges.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0)).alias(k) for k, c in bad.items()]).first()
    return row.asDict()


def build_graph(edges: DataFrame, num_nodes: int) -> Graph:
    """Checks edges (src, dst, capacity, cost, ext_edge_id) and gives them ids.

    The edges are written once, so their plan runs a single time however often
    the graph is read.  Up to a million edges are ranked in one sort; beyond
    that a row's id is its place within (cost, block of 1,024 sources) plus the
    rows of the blocks before, and the ranked edges are written too.
    """
    edges = materialise(edges.select("src", "dst", "capacity", "cost", "ext_edge_id"))
    found = violations(edges, num_nodes)
    broken = {k: v for k, v in found.items() if k != "rows" and v}
    if broken or num_nodes < 0:
        raise ValueError(f"bad edges: {broken}")
    if found["rows"] > 2**31 - 1:
        raise ValueError("edge ids would exceed 32 bits")
    base = edges.select(
        F.col("ext_edge_id").cast("long").alias("ext_edge_id"), F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"),
        F.col("capacity").cast("double").alias("capacity"), F.col("cost").cast("long").alias("cost"),
    )
    order = ["cost", "src", "dst", "ext_edge_id"]
    if found["rows"] <= 1_000_000:
        ranked = base.withColumn("edge_id", F.row_number().over(W.orderBy(*order)) - 1)
    else:
        block = F.floor(F.col("src") / 1024)
        keyed = base.withColumn("block", block)
        counts = keyed.groupBy("cost", "block").agg(F.count("*").alias("c"))
        starts = counts.withColumn("offset", F.coalesce(F.sum("c").over(W.orderBy("cost", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("c")
        local = F.row_number().over(W.partitionBy("cost", "block").orderBy("src", "dst", "ext_edge_id"))
        ranked = keyed.withColumn("place", local).join(starts, ["cost", "block"]).withColumn("edge_id", F.col("offset") + F.col("place") - 1)
    ranked = ranked.select(F.col("edge_id").cast("int").alias("edge_id"), "ext_edge_id", "src", "dst", "capacity", "cost")
    graph = Graph(ranked if found["rows"] <= 1_000_000 else materialise(ranked), num_nodes)
    graph.__dict__["num_edges"] = found["rows"]
    return graph


def from_arrays(spark: SparkSession, num_nodes: int, src, dst, capacity, cost, ext_edge_ids=None) -> Graph:
    """A graph of columns; ties in (cost, src, dst) keep the input order."""
    src, dst, cost = [int(x) for x in src], [int(x) for x in dst], [int(x) for x in cost]
    capacity = [float(x) for x in capacity]
    checked(num_nodes, src, dst, capacity, cost)
    ext = list(range(len(src))) if ext_edge_ids is None else [int(x) for x in ext_edge_ids]
    if len(ext) != len(src):
        raise ValueError("ext_edge_ids differs in length")
    order = sorted(range(len(src)), key=lambda i: (cost[i], src[i], dst[i], i))
    rows = [(k, ext[i], src[i], dst[i], capacity[i], cost[i]) for k, i in enumerate(order)]
    graph = Graph(spark.createDataFrame(rows, EDGE_SCHEMA), num_nodes)
    graph.__dict__["net"] = Net(num_nodes, *(list(c) for c in zip(*[(r[2], r[3], r[4], r[5], r[1]) for r in rows]))) if rows else Net(num_nodes, [], [], [], [])
    return graph
