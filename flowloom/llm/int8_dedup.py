"""Embedding near-dedup by int8-quantised tile products.

Unit vectors are quantised to int8 with a scale of their own.  With x = s q + e,

    |x.y - s_x s_y (q_x.q_y)| <= |e_x| + (1 + |e_x|) |e_y|

so a pair whose quantised product plus this bound stays under the threshold
cannot link; only the others are computed again in double precision.  Equal
vectors become one node first.  Blocks of nodes meet in tiles (block, block);
a tile returns each node's number of links and a spanning forest, not pairs.

Work grows with the square of the number of distinct vectors: every vector is
compared with every other one, as the contract has it.

Defined results
  null vector, null or non-finite component, zero vector   links with nothing
  vectors of different length                              do not link
  null vec_id          a row; component_id is the least non-null id, else null
  repeated rows        each is a vector: equal rows link with each other
  ties                 component_id is the smallest vec_id
  empty table          no rows
  extra columns        ignored, whatever their names
  long vectors         whole; a tile holds 2 * BLOCK vectors
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise

THRESHOLD, BLOCK, STRIP = 0.95, 4096, 512


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, error norms) of unit rows."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes, scale, error


def tile_links(x: np.ndarray, first: int, threshold: float, within: bool):
    """Pairs (row of the first block, row of the second) at or over the threshold.

    x: rows of both blocks, the first block in front; within: one block with itself.
    """
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else squares of tiny or huge components are lost
    norm = np.linalg.norm(x, axis=1)
    codes, scale, error = quantise(x / norm[:, None])
    wide = np.float32 if x.shape[1] * 127 * 127 < 2**24 else np.float64  # whole numbers stay exact
    q = codes.astype(wide)
    right = slice(0, None) if within else slice(first, None)
    base = 0 if within else first
    for a in range(0, first, STRIP):
        b = min(first, a + STRIP)
        guess = (q[a:b] @ q[right].T) * (scale[a:b, None] * scale[None, right])
        bound = error[a:b, None] + (1 + error[a:b, None]) * error[None, right] + 1e-9
        i, j = np.nonzero(guess + bound >= threshold)
        i, j = i + a, j + base
        if within:
            i, j = i[i < j], j[i < j]
        for c in range(0, i.size, 200_000):
            u, v = i[c : c + 200_000], j[c : c + 200_000]
            cos = np.einsum("nd,nd->n", x[u], x[v]) / (norm[u] * norm[v])
            hit = cos >= threshold
            yield u[hit], v[hit]


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (a root's is its own index) after the links i-j."""
    while i.size:
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def similar(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding)."""
    ok = (
        F.col("embedding").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("node", F.when(F.coalesce(ok, F.lit(False)), F.xxhash64("embedding")))
    nodes = materialise(rows.where("node IS NOT NULL").groupBy("node").agg(F.first("embedding").alias("embedding"), F.count("*").alias("times"), F.min("vec_id").alias("least_id")))
    blocks = max(1, -(-nodes.count() // block))

    def tile(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        table = table.sort_by([("own", "ascending"), ("node", "ascending")])
        own, node, times = (table.column(c).to_numpy() for c in ("own", "node", "times"))
        lists = table.column("embedding").combine_chunks()
        x = lists.flatten().to_numpy().reshape(table.num_rows, -1)
        links, label = np.zeros(node.size, np.int64), np.arange(node.size)
        first = int((own == i).sum())
        for u, v in tile_links(x, first, threshold, i == j) if first else ():
            links += np.bincount(u, times[v], node.size).astype(np.int64) + np.bincount(v, times[u], node.size).astype(np.int64)
            label = join_labels(label, u, v)
        some = links > 0
        return pa.table({"node": node[some], "links": links[some], "root": node[label[some]]})

    dealt = (
        nodes.select("node", "times", "embedding", F.size("embedding").alias("dim"), F.pmod("node", F.lit(blocks)).cast("int").alias("own"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select("node", "times", "embedding", "dim", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    found = materialise(dealt.groupBy("i", "j", "dim").applyInArrow(tile, "node long, links long, root long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found, "node", "root")
    named = comp.join(nodes.select("node", "least_id"), "node")
    lowest = named.groupBy("root").agg(F.min("least_id").alias("lowest"))
    result = materialise(
        nodes.select("node", "times", "least_id")
        .join(counts, "node", "left")
        .join(named.join(lowest, "root").select("node", "lowest"), "node", "left")
        .select("node", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("lowest", "least_id").alias("component"))
    )
    out = rows.select("vec_id", "node").join(result, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
