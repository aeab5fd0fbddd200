import pytest
from gridlark.operators import graph


def test_a_long_path_whose_end_is_the_smallest(spark):
    n = 150
    path = [(0, n), *((k, k - 1) for k in range(n, 1, -1)), (1000, 1000)]
    edges = spark.createDataFrame(path, "src long, dst long")
    alone = spark.createDataFrame([(500,)], "v long")
    got = {r.v: r.component for r in graph.connected_components(edges, alone).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 500: 500}
    with pytest.raises(RuntimeError):
        graph.connected_components(edges, rounds=1)
