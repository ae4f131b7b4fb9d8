"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "graph_build", "spf_distances", "spf_dag", "spf_kernel", "resolve_paths", "ksp_costs", "max_flow_single_tier", "max_flow_cost_distribution",
    "max_flow_equal_balanced", "edge_flows", "batch_failures", "policy_wcmp", "trade_max_flow",
)
#: mesh side, shortest-path sources, placements (W2's 200 placements are left out: minutes)
WORKLOADS = {"W0": (10, 50, 10), "W1": (20, 500, 100), "W2": (25, 1000, 0)}


def mesh(spark, n):
    """An n x n mesh with edges both ways, unit cost and capacity 100."""
    from flowloom.graph import from_arrays

    ends = [(i * n + j, i * n + j + 1) for i in range(n) for j in range(n - 1)] + [(i * n + j, i * n + n + j) for i in range(n - 1) for j in range(n)]
    ends += [(b, a) for a, b in ends]
    return from_arrays(spark, n * n, [a for a, _ in ends], [b for _, b in ends], [100.0] * len(ends), [1] * len(ends))


def mesh_spf(spark, n, calls):
    """Distances from ``calls`` sources in turn, one edge for each pair of nodes."""
    from flowloom.model import EdgeSelection
    from flowloom.operators import batch

    q = spark.range(calls).selectExpr("id AS query_id", f"cast(id % {n * n} AS int) AS src")
    return batch.spf(mesh(spark, n), q.withColumn("dst", q.src * 0 - 1), selection=EdgeSelection(multi_edge=False))


def mesh_placement(spark, n, demands):
    """Demands of 1,000 as 16 even single-path flows, each with a ledger of its own."""
    from flowloom.model import EdgeSelection, EdgeTieBreak, FlowPlacement, FlowPolicyConfig
    from flowloom.operators import batch

    last = n * n
    d = spark.range(demands).selectExpr(
        "id AS scenario_id", "0L AS demand_id", f"cast(id * 7 % {last} AS int) AS src", f"cast((id * 7 + {last} div 2 + id % 5) % {last} AS int) AS dst", "0 AS flow_class", "1000.0D AS volume"
    )
    config = FlowPolicyConfig(
        placement=FlowPlacement.EQUAL_BALANCED, multipath=False, min_flow_count=16, max_flow_count=16, reoptimize_flows_on_each_placement=True,
        selection=EdgeSelection(multi_edge=False, require_capacity=True, tie_break=EdgeTieBreak.PREFER_HIGHER_RESIDUAL),
    )
    return batch.place_demands(mesh(spark, n), d, config)[0]


def main() -> None:
    from flowloom.plans.queries import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(10).count()
    took = {}
    jobs = {name: (lambda f=QUERIES[name]: f(spark, sf)) for name in HEADLINE}
    for w, (n, calls, demands) in WORKLOADS.items():
        jobs[f"{w}_spf"] = lambda n=n, k=calls: mesh_spf(spark, n, k)
        if demands:
            jobs[f"{w}_placement"] = lambda n=n, k=demands: mesh_placement(spark, n, k)
    for name, job in jobs.items():
        began = time.time()
        job().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
