import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate.llm import negatives as N

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, anchor, low=50, high=95, positives=5, negatives=3):
    ok = [(k, i, v, lab) for k, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for k, i, v, lab in ok:
        if i is None or not anchor(i):
            continue
        scored = [(sum(int(a) * int(b) for a, b in zip(v, w)), j, own) for m, j, w, own in ok if m != k and len(w) == len(v)]
        for score, pos, _ in sorted((x for x in scored if x[2] == lab), key=order)[:positives]:
            fits = sorted((x for x in scored if x[2] != lab and low * score <= 100 * x[0] <= high * score), key=order)[:negatives]
            out += [(i, pos, n + 1, neg, score, s) for n, (s, neg, _) in enumerate(fits)]
    return sorted(out, key=str)


def run(spark, rows, every, **sizes):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"_anchor": F.lit("x"), "row": F.lit(1), "dim": F.lit(2)})
    return sorted([tuple(r) for r in N.mine(df, F.col("vec_id") % every == 0).collect()], key=str)


@pytest.mark.parametrize("sizes", [{}, {"ANCHOR_BYTES": 500, "BLOCK_BYTES": 900, "TILE": 2}, {"BLOCK_ROWS": 1}])
def test_against_brute_force(spark, monkeypatch, sizes):
    """Small components give many ties; repeated rows, ids that occur twice or not at all, a hot label, other lengths, odd vectors."""
    for k, v in sizes.items():
        monkeypatch.setattr(N, k, v)
    r = np.random.default_rng(1)
    rows = [(k, r.integers(-3, 6, 6).astype(float).tolist(), int(r.choice([0, 0, 0, 1, 2, 3]))) for k in range(150)]
    rows += [(10, rows[10][1], rows[10][2]), (10, rows[20][1], 1), (None, rows[30][1], 0), (None, rows[31][1], 1)] + [(500 + k, rows[40][1], 0) for k in range(12)]
    rows += [(600 + k, [float(x) for x in r.integers(0, 4, 2)], k % 2) for k in range(12)] + [(700, [1.0] * 6, 9), (710, [], 1), (711, [], 2)]
    rows += [(800, None, 1), (810, [float("nan")] * 6, 1), (820, [float("inf")] * 6, 1), (830, [None] * 6, 1), (840, [1.0] * 6, None)]
    found = run(spark, rows, 10)
    assert found == brute(rows, lambda i: i % 10 == 0) and len(found) > 100


def test_edges(spark):
    assert run(spark, [], 2) == []
    assert run(spark, [(1, [1.0], 0), (3, [2.0], 1)], 2) == []  # no anchors
    assert run(spark, [(2, [1.0], 0), (3, [2.0], 1)], 2) == []  # an anchor without positives
    with pytest.raises(Exception, match="2\\^53"):
        run(spark, [(2, [2.0**30], 0), (3, [2.0**30], 0)], 2)


def test_integers(spark):
    rows = [(7, [0.5, -0.001, float("nan"), float("-inf")], 9), (8, [1.0], None), (None, None, 3)]
    got = [tuple(r) for r in N.integers(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got[0][1][:2] == [128.0, -1.0] and math.isnan(got[0][1][2]) and got[0][1][3] == -math.inf and got[0][2] == 0
    assert got[1:] == [(8, [256.0], None), (None, None, 3)]
