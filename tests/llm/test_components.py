"""Connected components against a plain search, with hubs and chains."""

import random

import pytest

from tidegauge.llm._shared import connected_components


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root if find(x) != x}


def cases():
    rng = random.Random(5)
    yield "hub at the bottom", [(0, x) for x in range(1, 3000)]
    yield "hub at the top", [(5000, x) for x in range(3000)] + [(7000, 7001)]
    yield "chain", [(x, x + 1) for x in range(70)]
    yield "sparse", [(rng.randrange(2000), rng.randrange(2000)) for _ in range(1200)]
    yield "hubs in a chain", [(x, x * 100 + y) for x in range(1, 9) for y in range(1, 99)] + [(x, x + 1) for x in range(1, 9)]
    yield "loops and repeats", [(1, 1), (2, 3), (3, 2), (2, 3)]
    yield "none", []


@pytest.mark.parametrize("name,edges", list(cases()))
def test_equals_a_plain_search(spark, name, edges):
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.root for r in got} == plain(edges)
