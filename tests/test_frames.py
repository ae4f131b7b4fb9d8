"""The relational route on long paths."""

import pytest

from flowloom.operators import frames


def test_list_paths_of_any_length(spark):
    """A chain of 70 edges whose last hop is doubled: both paths, whole."""
    n = 70
    tree = [(1, i + 1, i, i) for i in range(n)] + [(1, n, n - 1, n)]
    tree = spark.createDataFrame(tree, "query_id long, node int, parent int, edge_id int").coalesce(1)
    targets = spark.createDataFrame([(1, 0, n)], "query_id long, src int, dst int").coalesce(1)
    got = sorted(list(r.edges) for r in frames.list_paths(tree, targets).collect())
    assert got == [list(range(n)), [*range(n - 1), n]]
    with pytest.raises(ValueError):
        frames.list_paths(tree, targets, max_hops=3)
