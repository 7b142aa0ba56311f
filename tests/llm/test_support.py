import random

import pytest

from lexmill.llm.support import Shelf, connected_components, shared_folder


@pytest.mark.parametrize("edges_a_task", [500_000, 20])
def test_components_match_union_find(spark, edges_a_task):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500 + i) for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    expected = {x: find(x) for x in parent if find(x) != x}
    got = connected_components(spark, spark.createDataFrame(edges, "a long, b long"), Shelf(spark), "t", edges_a_task)
    assert {r.node: r.root for r in got.collect()} == expected


def test_no_edges(spark):
    assert connected_components(spark, spark.createDataFrame([], "a long, b long"), Shelf(spark), "t").count() == 0


def test_the_shared_folder_is_the_session_s(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
