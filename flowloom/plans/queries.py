"""Registered graph queries and the DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EdgeSelection, EdgeTieBreak, FlowPlacement, FlowPolicyConfig, MaxFlowOptions
from ..operators import batch, frames
from ..sources import networks

E, P = FlowPlacement.EQUAL_BALANCED, FlowPlacement.PROPORTIONAL


def rounded(value, places: int):
    """Rounded as DuckDB rounds: the scaled double, not the decimal digits that it prints, decides at a half."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value * 10.0**places, 0) / 10.0**places


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_nationkey").cast("int").alias("src"))


def nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = sources(spark, sf_dir)
    return a.withColumn("dst", F.explode(F.sequence(F.lit(0), F.lit(24)))).where("src <> dst").select((F.col("src") * 100 + F.col("dst")).cast("long").alias("query_id"), "src", "dst")


def graph_build(spark, sf_dir):
    return networks.trade(spark, sf_dir).edges


def graph_degrees(spark, sf_dir):
    return networks.trade(spark, sf_dir).degrees().select("node", *[F.col(c).cast("long").alias(c) for c in ("out_degree", "in_degree", "out_offset", "in_offset")])


def event_transitions(spark, sf_dir):
    return networks.event_edges(spark, sf_dir)


def spf_distances(spark, sf_dir):
    return frames.distances(frames.allowed(networks.trade(spark, sf_dir).edges), sources(spark, sf_dir))


def spf_dag(spark, sf_dir):
    e = frames.materialise(frames.allowed(networks.trade(spark, sf_dir).edges))
    return frames.dag(e, frames.distances(e, sources(spark, sf_dir)))


def spf_masked(spark, sf_dir):
    g = networks.trade(spark, sf_dir)
    nodes = spark.createDataFrame([(3,), (7,)], "node int")
    barred = g.edges.where("ext_edge_id % 5 = 0").select("edge_id")
    e = frames.materialise(frames.allowed(g.edges, nodes, barred))
    return frames.distances(e, sources(spark, sf_dir).where("src NOT IN (3, 7)"))


def spf_kernel(spark, sf_dir):
    """The kernel's distances; the oracle is that of spf_distances."""
    return batch.spf(networks.trade(spark, sf_dir), sources(spark, sf_dir).withColumn("dst", F.lit(-1))).select("query_id", "node", "dist")


def resolve_paths(spark, sf_dir):
    g = networks.two_hop(spark, sf_dir)
    q = networks.pairs(spark, sf_dir)
    return batch.resolve_to_paths(g, q, split_parallel_edges=False).select("query_id", F.element_at("hops", 2)["node"].alias("mid"), F.size(F.element_at("hops", 1)["edges"]).alias("first_edges"), F.size(F.element_at("hops", 2)["edges"]).alias("second_edges"))


def ksp_costs(spark, sf_dir):
    g = networks.two_hop(spark, sf_dir, tiers=3)
    return batch.ksp(g, networks.pairs(spark, sf_dir), 4).select("query_id", F.col("path_no").cast("int").alias("path_no"), "cost")


def max_flow_single_tier(spark, sf_dir):
    g = networks.two_hop(spark, sf_dir)
    return batch.max_flow(g, networks.pairs(spark, sf_dir), MaxFlowOptions(shortest_path=True)).select("query_id", rounded("total_flow", 4).alias("total_flow"))


def max_flow_cost_distribution(spark, sf_dir):
    g = networks.two_hop(spark, sf_dir, tiers=3)
    s = batch.max_flow(g, networks.pairs(spark, sf_dir))
    return s.select("query_id", F.explode("cost_dist").alias("t")).select("query_id", F.col("t.cost").alias("cost"), rounded("t.flow", 4).alias("flow"))


def max_flow_equal_balanced(spark, sf_dir):
    g = networks.two_hop(spark, sf_dir)
    return batch.max_flow(g, networks.pairs(spark, sf_dir), MaxFlowOptions(placement=E, shortest_path=True)).select("query_id", rounded("total_flow", 4).alias("total_flow"))


def equal_balanced_frames(spark, sf_dir):
    """The relational form of the even split, over the same pairs."""
    g = networks.two_hop(spark, sf_dir)
    q = networks.pairs(spark, sf_dir)
    e = frames.materialise(frames.allowed(g.edges))
    tree = frames.dag(e, frames.distances(e, q.select("query_id", "src")))
    return frames.equal_balanced(tree, e, q).select("query_id", rounded("total", 4).alias("total_flow"))


def min_cut_capacity(spark, sf_dir):
    g = networks.two_hop(spark, sf_dir)
    s = batch.max_flow(g, networks.pairs(spark, sf_dir)).select("query_id", F.explode("min_cut").alias("edge_id"))
    return s.join(g.edges.select("edge_id", "capacity"), "edge_id").groupBy("query_id").agg(F.sum("capacity").alias("cut_capacity"))


def edge_flows(spark, sf_dir):
    g = networks.two_hop(spark, sf_dir)
    f = batch.edge_flows(g, networks.pairs(spark, sf_dir), MaxFlowOptions(shortest_path=True))
    return f.join(g.edges.select("edge_id", "ext_edge_id"), "edge_id").select("query_id", "ext_edge_id", rounded("flow", 3).alias("flow"))


def batch_failures(spark, sf_dir):
    """Max-flow of every pair in scenarios that each lose the suppliers of one residue class."""
    g = networks.two_hop(spark, sf_dir)
    q = networks.pairs(spark, sf_dir).withColumn("scenario_id", F.explode(F.array([F.lit(i) for i in range(4)])))
    q = q.withColumn("query_id", F.col("query_id") * 10 + F.col("scenario_id"))
    lost = networks.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 4).cast("int").alias("scenario_id"), (F.col("s_suppkey") + networks.SUPPLIER_AT).cast("int").alias("node"))
    return batch.max_flow(g, batch.with_masks(q, lost)).select("query_id", rounded("total_flow", 4).alias("total_flow"))


def sensitivity(spark, sf_dir):
    g = networks.two_hop(spark, sf_dir)
    s = batch.sensitivity(g, networks.pairs(spark, sf_dir))
    return s.join(g.edges.select("edge_id", "ext_edge_id"), "edge_id").select("query_id", "ext_edge_id", rounded("loss", 4).alias("loss"))


def policy_wcmp(spark, sf_dir):
    """One demand of 500 for each pair, each with a ledger of its own."""
    g = networks.two_hop(spark, sf_dir)
    d = networks.pairs(spark, sf_dir).select(F.col("query_id").alias("scenario_id"), F.lit(0).cast("long").alias("demand_id"), "src", "dst", F.lit(0).alias("flow_class"), F.lit(500.0).alias("volume"))
    config = FlowPolicyConfig(placement=P, shortest_path=True)
    done, _ = batch.place_demands(g, d, config)
    return done.select("scenario_id", rounded("placed", 4).alias("placed"), rounded("leftover", 4).alias("leftover"))


def class_ledger(spark, sf_dir):
    """The ledger of one unlimited demand for each pair, in class query_id mod 2, each with a ledger of its own."""
    g = networks.two_hop(spark, sf_dir)
    d = networks.pairs(spark, sf_dir).select(F.col("query_id").alias("scenario_id"), F.lit(0).cast("long").alias("demand_id"), "src", "dst", (F.col("query_id") % 2).cast("int").alias("flow_class"), F.lit(1e9).alias("volume"))
    return g, batch.place_demands(g, d, FlowPolicyConfig(placement=P, shortest_path=True))[1]


def ledger_remove_class(spark, sf_dir):
    """Flow left on each edge over all ledgers after class 1 goes."""
    g, ledger = class_ledger(spark, sf_dir)
    left = frames.remove_by_class(ledger, 1).groupBy("edge_id").agg(F.sum("flow").alias("flow"))
    return left.join(g.edges.select("edge_id", "ext_edge_id"), "edge_id").select("ext_edge_id", rounded("flow", 2).alias("flow"))


def ledger_flows(spark, sf_dir):
    """Edges and volume at the source of each flow in the ledgers."""
    g, ledger = class_ledger(spark, sf_dir)
    first = ledger.join(g.edges.select("edge_id", F.col("src").alias("from_node")), "edge_id")
    return first.groupBy(F.col("scenario_id").alias("query_id"), F.col("flow_class").cast("int").alias("flow_class")).agg(
        F.count("*").alias("edges"), rounded(F.sum(F.when(F.col("from_node") == F.col("src"), F.col("flow"))), 3).alias("volume")
    )


def split_paths(spark, sf_dir):
    """Paths of one edge a hop through each middle node."""
    g = networks.two_hop(spark, sf_dir)
    p = batch.resolve_to_paths(g, networks.pairs(spark, sf_dir), split_parallel_edges=True)
    return p.groupBy("query_id", F.element_at("hops", 2)["node"].alias("mid")).agg(F.count("*").alias("paths"), F.max(F.size(F.element_at("hops", 1)["edges"])).cast("long").alias("edges_a_hop"))


def capped_paths(spark, sf_dir):
    """At most three paths are listed."""
    g = networks.two_hop(spark, sf_dir)
    p = batch.resolve_to_paths(g, networks.pairs(spark, sf_dir), split_parallel_edges=True, max_paths=3)
    return p.groupBy("query_id").agg(F.count("*").alias("paths"))


def ksp_within_factor(spark, sf_dir):
    """Of up to 40 paths those that cost at most 1.5 times the least."""
    g = networks.two_hop(spark, sf_dir, tiers=3)
    return batch.ksp(g, networks.pairs(spark, sf_dir), 40, max_cost_factor=1.5).groupBy("query_id").agg(F.count("*").alias("paths"), F.max("cost").alias("most"))


def ksp_dag_distances(spark, sf_dir):
    """Distance to the target in each of two paths' own DAGs."""
    g = networks.two_hop(spark, sf_dir, tiers=3)
    q = networks.pairs(spark, sf_dir)
    d = batch.ksp_dags(g, q, 2).join(q.select("query_id", F.col("dst").alias("node")), ["query_id", "node"])
    return d.select("query_id", F.col("path_no").cast("int").alias("path_no"), "dist", F.size("parents").cast("int").alias("parents"))


def policy_cost_factor(spark, sf_dir):
    """One demand of 500 for each pair over paths that cost at most 1.5 times the least."""
    g = networks.two_hop(spark, sf_dir, tiers=3)
    d = networks.pairs(spark, sf_dir).select(F.col("query_id").alias("scenario_id"), F.lit(0).cast("long").alias("demand_id"), "src", "dst", F.lit(0).alias("flow_class"), F.lit(500.0).alias("volume"))
    done, _ = batch.place_demands(g, d, FlowPolicyConfig(placement=P, max_path_cost_factor=1.5))
    return done.select("scenario_id", rounded("placed", 3).alias("placed"))


def policy_even(spark, sf_dir):
    """One demand of 50 for each pair, split evenly over the shortest paths."""
    g = networks.two_hop(spark, sf_dir)
    d = networks.pairs(spark, sf_dir).select(F.col("query_id").alias("scenario_id"), F.lit(0).cast("long").alias("demand_id"), "src", "dst", F.lit(0).alias("flow_class"), F.lit(50.0).alias("volume"))
    done, _ = batch.place_demands(g, d, FlowPolicyConfig(placement=E, shortest_path=True))
    return done.select("scenario_id", rounded("placed", 3).alias("placed"))


def single_edge_selection(spark, sf_dir):
    """The first hop's edge when one edge a pair is taken: the one with the most room."""
    g = networks.two_hop(spark, sf_dir)
    chosen = EdgeSelection(multi_edge=False, tie_break=EdgeTieBreak.PREFER_HIGHER_RESIDUAL)
    hop = F.element_at("hops", 1)["edges"]
    p = batch.resolve_to_paths(g, networks.pairs(spark, sf_dir), selection=chosen)
    p = p.select("query_id", F.element_at("hops", 2)["node"].alias("mid"), F.size(hop).alias("edges"), F.element_at(hop, 1).alias("edge_id"))
    return p.join(g.edges.select("edge_id", "capacity"), "edge_id").select("query_id", "mid", "edges", "capacity")


def reachable_after_flow(spark, sf_dir):
    """Middle nodes that the source still reaches once the flow is placed."""
    g = networks.two_hop(spark, sf_dir)
    s = batch.max_flow(g, networks.pairs(spark, sf_dir), MaxFlowOptions(with_reachable=True)).where("total_flow > 0")
    return s.select("query_id", F.expr("size(filter(sequence(100, size(reachable) - 1), i -> reachable[i]))").cast("long").alias("reached"))


def trade_max_flow(spark, sf_dir):
    """All-pairs max-flow on the trade network (no closed form in SQL)."""
    return batch.max_flow(networks.trade(spark, sf_dir), nation_pairs(spark, sf_dir)).select("query_id", "src", "dst", F.round("total_flow", 6).alias("total_flow"), F.size("cost_dist").alias("tiers"), F.size("min_cut").alias("cut_edges"))


def trade_sensitivity(spark, sf_dir):
    """All pairs of nations (no closed form in SQL)."""
    return batch.sensitivity(networks.trade(spark, sf_dir), nation_pairs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    graph_build, graph_degrees, event_transitions, spf_distances, spf_dag, spf_masked, spf_kernel, resolve_paths, ksp_costs, max_flow_single_tier,
    max_flow_cost_distribution, max_flow_equal_balanced, equal_balanced_frames, min_cut_capacity, edge_flows, batch_failures, sensitivity, policy_wcmp,
    ledger_remove_class, ledger_flows, split_paths, capped_paths, ksp_within_factor, ksp_dag_distances, policy_cost_factor, policy_even,
    single_edge_selection, reachable_after_flow, trade_max_flow, trade_sensitivity,
)}

TRADE = """trade AS (
  SELECT CAST(s_nationkey AS INTEGER) AS src, CAST(c_nationkey AS INTEGER) AS dst, SUM(l_quantity) AS capacity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2),
edges AS (
  SELECT CAST(ROW_NUMBER() OVER (ORDER BY cost, src, dst, ext_edge_id) - 1 AS INTEGER) AS edge_id, * FROM (
    SELECT CAST(src * 1000 + dst AS BIGINT) AS ext_edge_id, src, dst, capacity, CAST(1 + (src * 7 + dst * 11) % 13 AS BIGINT) AS cost FROM trade))"""


def min_plus(edges: str, nodes: str = "SELECT CAST(n_nationkey AS INTEGER) AS n FROM nation") -> str:
    """CTEs d1..d5: distances over at most 2^k hops by repeated squaring."""
    out = [f"d0 AS (SELECT s, t, MIN(d) AS d FROM (SELECT n AS s, n AS t, CAST(0 AS BIGINT) AS d FROM ({nodes}) UNION ALL SELECT src, dst, cost FROM {edges}) GROUP BY 1, 2)"]
    out += [f"d{k} AS (SELECT a.s, b.t, MIN(a.d + b.d) AS d FROM d{k - 1} a JOIN d{k - 1} b ON a.t = b.s GROUP BY 1, 2)" for k in range(1, 6)]
    return ",\n".join(out)


def two_hop_sql(tiers: int = 1) -> str:
    return f"""ins AS (
  SELECT CAST(s_nationkey AS INTEGER) AS n, s_suppkey AS m, ASCII(l_returnflag) AS flag, CAST(FLOOR(q / 20) + 1 AS DOUBLE) AS cap, 1 + s_suppkey % {tiers} AS cost
  FROM (SELECT l_suppkey, l_returnflag, SUM(l_quantity) AS q FROM lineitem GROUP BY 1, 2) JOIN supplier ON l_suppkey = s_suppkey),
outs AS (
  SELECT l_suppkey AS m, CAST(regexp_extract(p_brand, '[0-9]+$') AS INTEGER) % 50 + 50 AS b, ASCII(l_returnflag) AS flag, SUM(l_quantity) AS cap
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
pairs AS (SELECT CAST(n_nationkey * 100 + b AS BIGINT) AS query_id, CAST(n_nationkey AS INTEGER) AS n, b FROM nation, (SELECT DISTINCT b FROM (SELECT CAST(regexp_extract(p_brand, '[0-9]+$') AS INTEGER) % 50 + 50 AS b FROM part))),
gi AS (SELECT n, m, cost, SUM(cap) AS cap, MIN(cap) AS low, COUNT(*) AS k FROM ins GROUP BY 1, 2, 3),
go AS (SELECT m, b, SUM(cap) AS cap, MIN(cap) AS low, COUNT(*) AS k FROM outs GROUP BY 1, 2),
mids AS (SELECT query_id, p.n, p.b, gi.m, gi.cost + 1 AS cost, gi.cap AS cin, go.cap AS cout, gi.low AS lin, go.low AS lout, gi.k AS kin, go.k AS kout
  FROM pairs p JOIN gi ON gi.n = p.n JOIN go ON go.m = gi.m AND go.b = p.b)"""


def single_tier(extra: str = "") -> str:
    return f"WITH {two_hop_sql()} SELECT p.query_id, ROUND(COALESCE(SUM(LEAST(cin, cout)), 0), 4) AS total_flow FROM pairs p LEFT JOIN mids ON mids.query_id = p.query_id {extra} GROUP BY 1"


EVEN = f"""WITH {two_hop_sql()},
even AS (SELECT query_id, kin * 1.0 / SUM(kin) OVER (PARTITION BY query_id) AS share, lin, kin, lout, kout FROM mids)
SELECT p.query_id, ROUND(COALESCE(MIN(LEAST(lin * kin / share, lout * kout / share)), 0), 4) AS total_flow FROM pairs p LEFT JOIN even ON even.query_id = p.query_id GROUP BY 1"""

DISTANCES = f"WITH {TRADE},\n{min_plus('edges')}\nSELECT CAST(s AS BIGINT) AS query_id, t AS node, d AS dist FROM d5"

ORACLES = {
    "graph_build": f"WITH {TRADE} SELECT edge_id, ext_edge_id, src, dst, capacity, cost FROM edges",
    "graph_degrees": f"""WITH {TRADE}, o AS (SELECT src AS node, COUNT(*) AS c FROM edges GROUP BY 1), i AS (SELECT dst AS node, COUNT(*) AS c FROM edges GROUP BY 1),
 n AS (SELECT CAST(range AS INTEGER) AS node FROM range(25)), j AS (SELECT n.node, CAST(COALESCE(o.c, 0) AS BIGINT) AS out_degree, CAST(COALESCE(i.c, 0) AS BIGINT) AS in_degree FROM n LEFT JOIN o USING (node) LEFT JOIN i USING (node))
 SELECT node, out_degree, in_degree, CAST(SUM(out_degree) OVER (ORDER BY node) - out_degree AS BIGINT) AS out_offset, CAST(SUM(in_degree) OVER (ORDER BY node) - in_degree AS BIGINT) AS in_offset FROM j""",
    "event_transitions": """SELECT event_type, next_type, COUNT(*) AS transitions FROM (
 SELECT event_type, LEAD(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_type FROM events) WHERE next_type IS NOT NULL GROUP BY 1, 2""",
    "spf_distances": DISTANCES,
    "spf_kernel": DISTANCES,
    "spf_dag": f"WITH {TRADE},\n{min_plus('edges')}\nSELECT CAST(a.s AS BIGINT) AS query_id, e.dst AS node, e.src AS parent, e.edge_id FROM edges e JOIN d5 a ON a.t = e.src JOIN d5 b ON b.s = a.s AND b.t = e.dst WHERE e.src <> e.dst AND a.d + e.cost = b.d",
    "spf_masked": f"WITH {TRADE},\nopen AS (SELECT * FROM edges WHERE src NOT IN (3, 7) AND dst NOT IN (3, 7) AND ext_edge_id % 5 <> 0),\n{min_plus('open', 'SELECT CAST(n_nationkey AS INTEGER) AS n FROM nation WHERE n_nationkey NOT IN (3, 7)')}\nSELECT CAST(s AS BIGINT) AS query_id, t AS node, d AS dist FROM d5",
    "resolve_paths": f"WITH {two_hop_sql()} SELECT query_id, CAST(m + 100 AS INTEGER) AS mid, CAST(kin AS INTEGER) AS first_edges, CAST(kout AS INTEGER) AS second_edges FROM mids",
    "ksp_costs": f"""WITH {two_hop_sql(3)} SELECT query_id, CAST(rn - 1 AS INTEGER) AS path_no, CAST(cost AS BIGINT) AS cost FROM (
 SELECT query_id, cost, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY cost) AS rn FROM mids, range(100) WHERE range < kin * kout) WHERE rn <= 4""",
    "max_flow_single_tier": single_tier(),
    "max_flow_cost_distribution": f"WITH {two_hop_sql(3)} SELECT query_id, CAST(cost AS BIGINT) AS cost, ROUND(SUM(LEAST(cin, cout)), 4) AS flow FROM mids GROUP BY 1, 2",
    "max_flow_equal_balanced": EVEN,
    "equal_balanced_frames": EVEN,
    "min_cut_capacity": f"WITH {two_hop_sql()} SELECT query_id, SUM(LEAST(cin, cout)) AS cut_capacity FROM mids GROUP BY 1",
    "edge_flows": f"""WITH {two_hop_sql()} SELECT query_id, CAST(mids.n AS BIGINT) * 100000000000 + (mids.m + 100) * 1000 + ins.flag AS ext_edge_id, ROUND(LEAST(cin, cout) * ins.cap / cin, 3) AS flow FROM mids JOIN ins ON ins.m = mids.m
 UNION ALL SELECT query_id, CAST(mids.m + 100 AS BIGINT) * 100000000000 + mids.b * 1000 + outs.flag, ROUND(LEAST(cin, cout) * outs.cap / cout, 3) FROM mids JOIN outs ON outs.m = mids.m AND outs.b = mids.b""",
    "batch_failures": f"""WITH {two_hop_sql()} SELECT p.query_id * 10 + f.range AS query_id, ROUND(COALESCE(SUM(LEAST(cin, cout)) FILTER (WHERE mids.m % 4 <> f.range), 0), 4) AS total_flow
 FROM pairs p CROSS JOIN range(4) f LEFT JOIN mids ON mids.query_id = p.query_id GROUP BY 1""",
    "sensitivity": f"""WITH {two_hop_sql()}, lost AS (
 SELECT query_id, CAST(mids.n AS BIGINT) * 100000000000 + (mids.m + 100) * 1000 + ins.flag AS ext_edge_id, LEAST(cin, cout) - LEAST(cin - ins.cap, cout) AS loss FROM mids JOIN ins ON ins.m = mids.m WHERE cin <= cout
 UNION ALL SELECT query_id, CAST(mids.m + 100 AS BIGINT) * 100000000000 + mids.b * 1000 + outs.flag, LEAST(cin, cout) - LEAST(cin, cout - outs.cap) FROM mids JOIN outs ON outs.m = mids.m AND outs.b = mids.b WHERE cout <= cin)
 SELECT query_id, ext_edge_id, ROUND(loss, 4) AS loss FROM lost WHERE loss > 1.0 / 4096""",
    "ledger_remove_class": f"""WITH {two_hop_sql()}, f AS (
 SELECT CAST(mids.n AS BIGINT) * 100000000000 + (mids.m + 100) * 1000 + ins.flag AS ext_edge_id, LEAST(cin, cout) * ins.cap / cin AS flow FROM mids JOIN ins ON ins.m = mids.m WHERE query_id % 2 = 0
 UNION ALL SELECT CAST(mids.m + 100 AS BIGINT) * 100000000000 + mids.b * 1000 + outs.flag, LEAST(cin, cout) * outs.cap / cout FROM mids JOIN outs ON outs.m = mids.m AND outs.b = mids.b WHERE query_id % 2 = 0)
 SELECT ext_edge_id, ROUND(SUM(flow), 2) AS flow FROM f GROUP BY 1""",
    "ledger_flows": f"WITH {two_hop_sql()} SELECT query_id, CAST(query_id % 2 AS INTEGER) AS flow_class, CAST(SUM(kin + kout) AS BIGINT) AS edges, ROUND(SUM(LEAST(cin, cout)), 3) AS volume FROM mids GROUP BY 1, 2",
    "split_paths": f"WITH {two_hop_sql()} SELECT query_id, CAST(m + 100 AS INTEGER) AS mid, CAST(kin * kout AS BIGINT) AS paths, CAST(1 AS BIGINT) AS edges_a_hop FROM mids",
    "capped_paths": f"WITH {two_hop_sql()} SELECT query_id, CAST(LEAST(3, SUM(kin * kout)) AS BIGINT) AS paths FROM mids GROUP BY 1",
    "ksp_within_factor": f"""WITH {two_hop_sql(3)}, c AS (SELECT query_id, cost, MIN(cost) OVER (PARTITION BY query_id) AS best, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY cost) AS rn FROM mids, range(100) WHERE range < kin * kout)
 SELECT query_id, COUNT(*) AS paths, CAST(MAX(cost) AS BIGINT) AS most FROM c WHERE rn <= 40 AND cost <= 1.5 * best GROUP BY 1""",
    "ksp_dag_distances": f"""WITH {two_hop_sql(3)} SELECT query_id, CAST(rn - 1 AS INTEGER) AS path_no, CAST(cost AS BIGINT) AS dist, CAST(1 AS INTEGER) AS parents FROM (
 SELECT query_id, cost, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY cost) AS rn FROM mids, range(100) WHERE range < kin * kout) WHERE rn <= 2""",
    "policy_cost_factor": f"""WITH {two_hop_sql(3)}, c AS (SELECT query_id, LEAST(cin, cout) AS flow, cost, MIN(cost) OVER (PARTITION BY query_id) AS best FROM mids)
 SELECT p.query_id AS scenario_id, ROUND(LEAST(500, COALESCE(SUM(flow) FILTER (WHERE cost <= FLOOR(1.5 * best)), 0)), 3) AS placed FROM pairs p LEFT JOIN c ON c.query_id = p.query_id GROUP BY 1""",
    "policy_even": f"SELECT query_id AS scenario_id, ROUND(LEAST(50, total_flow), 3) AS placed FROM ({EVEN})",
    "single_edge_selection": f"""WITH {two_hop_sql()} SELECT query_id, CAST(mids.m + 100 AS INTEGER) AS mid, CAST(1 AS INTEGER) AS edges, MAX(ins.cap) AS capacity FROM mids JOIN ins ON ins.m = mids.m GROUP BY 1, mids.m""",
    "reachable_after_flow": f"""WITH {two_hop_sql()}, total AS (SELECT query_id FROM mids GROUP BY 1)
 SELECT t.query_id, COUNT(gi.m) FILTER (WHERE mids.m IS NULL OR mids.cin > mids.cout) AS reached
 FROM total t JOIN pairs p ON p.query_id = t.query_id LEFT JOIN gi ON gi.n = p.n LEFT JOIN mids ON mids.query_id = p.query_id AND mids.m = gi.m GROUP BY 1""",
    "policy_wcmp": f"""WITH {two_hop_sql()}, t AS (SELECT p.query_id, LEAST(500, COALESCE(SUM(LEAST(cin, cout)), 0)) AS placed FROM pairs p LEFT JOIN mids ON mids.query_id = p.query_id GROUP BY 1)
 SELECT query_id AS scenario_id, ROUND(placed, 4) AS placed, ROUND(500 - placed, 4) AS leftover FROM t""",
}
