import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate.llm import embeddings as E

from .helpers import table

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows):
    ok = lambda v, l: v is not None and l is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)  # noqa: E731, E741
    use = [(k, i, np.array(v, np.float32).astype(float), lab) for k, (i, v, lab) in enumerate(rows) if ok(v, lab)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(use)):
        for b in range(a):
            ka, _, va, la = use[a]
            kb, _, vb, lb = use[b]
            if la == lb and len(va) == len(vb) and va @ vb / np.linalg.norm(va) / np.linalg.norm(vb) >= E.COSINE:
                links[ka] += 1
                links[kb] += 1
                parent[find(ka)] = find(kb)
    low = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, links[k], low.get(find(k)), i is not None and i == low.get(find(k))) for k, (i, *_) in enumerate(rows)), key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted([tuple(r) for r in E.near_duplicates(df).collect()], key=str)


@pytest.mark.parametrize("block,leaf,run_", [(512, 64, 32), (8, 3, 2)])
def test_against_brute_force(spark, monkeypatch, block, leaf, run_):
    """Clusters, a hot vector with copies and near copies, and odd vectors of every kind."""
    for k, v in (("BLOCK", block), ("LEAF", leaf), ("RUN", run_)):
        monkeypatch.setattr(E, k, v)
    r = np.random.default_rng(2)
    rows, hot = [], r.normal(size=8)
    for k in range(120):
        base = r.normal(size=8)
        for _ in range(r.integers(1, 4)):
            rows.append((base + r.normal(size=8) * r.choice([0.02, 0.1]), int(r.integers(0, 3))))
    rows += [(hot, 1)] * 30 + [(hot + r.normal(size=8) * 0.03, 1) for _ in range(40)] + [(hot * 5, 1), (hot, 2), (-hot, 1)]
    rows = [(int(i), [float(x) for x in v], lab) for i, (v, lab) in zip(r.permutation(len(rows)), rows)]
    odd = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] * 8, [None] + [1.0] * 7, [1.0, 0.0], [1.0, 0.0]]
    rows += [(1000 + k, v, 1) for k, v in enumerate(odd)] + [(2000, rows[0][1], None), (None, rows[0][1], rows[0][2]), (3, rows[5][1], rows[5][2])]
    assert run(spark, rows) == brute(rows)


def test_edges(spark, sf_dir):
    assert run(spark, []) == []
    assert run(spark, [(5, None, 1), (6, [1.0], None)]) == [(5, 0, 5, True), (6, 0, 6, True)]
    given = table(spark, sf_dir, "embeddings").withColumns({"node": F.lit("x"), "dim": F.lit(1), "least": F.lit(2)})
    rows = [tuple(r) for r in given.select("vec_id", "embedding", "label").collect()]
    assert sorted([tuple(r) for r in E.near_duplicates(given).collect()], key=str) == brute(rows)
