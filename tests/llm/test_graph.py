import random

import numpy as np

from ordinate.llm import graph


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(1001, 1200)] + [(r.randint(-400, -1), r.randint(-400, -1)) for _ in range(300)]
    edges += [(5, 5), (7777, 7777), (1, 0), (1, 0)]
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "u bigint, v bigint").repartition(7)
    assert {x.node: x.component for x in graph.components(df).collect()} == brute(edges)
    assert graph.components(df.limit(0)).count() == 0


def test_forest():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 300, 250), r.integers(0, 300, 250)
    u, v = graph.forest(a, b)
    want = {x: c for x, c in brute(list(zip(a.tolist(), b.tolist()))).items() if x != c}
    assert dict(zip(u.tolist(), v.tolist())) == want
