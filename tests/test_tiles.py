"""Products of tiled matrices, and tiled attention, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate.errors import ConfigError, ShapeError
from ordinate.frame import TensorFrame
from ordinate.operators import tiles
from ordinate.operators.attention import attention

R = np.random.default_rng(0)


def of(spark, a):
    return TensorFrame.from_data(spark, a.ravel().tolist(), a.shape)


def back(t):
    return np.array(t.to_data()).reshape(t.shape)


@pytest.mark.parametrize("side,held", [(4, 1 << 26), (3, 100), (64, 1 << 26)])
@pytest.mark.parametrize("shape", [(7, 9, 5), (1, 8, 1), (4, 4, 4)])
@pytest.mark.parametrize("ta,tb", [(False, False), (True, False), (False, True)])
def test_product(spark, monkeypatch, side, held, shape, ta, tb):
    monkeypatch.setattr(tiles, "HELD_BYTES", held)
    m, k, n = shape
    a, b = R.normal(size=(k, m) if ta else (m, k)), R.normal(size=(n, k) if tb else (k, n))
    got = tiles.matmul(tiles.Tiles.of(of(spark, a), side), tiles.Tiles.of(of(spark, b), side), ta, tb)
    assert got.shape == (m, n)
    np.testing.assert_allclose(back(got.frame()), (a.T if ta else a) @ (b.T if tb else b), atol=1e-12)


def test_batches_rows_and_gradients(spark):
    a, b = R.normal(size=(2, 3, 5, 4)), R.normal(size=(2, 3, 4, 6))
    got = tiles.matmul(tiles.Tiles.of(of(spark, a), 3), tiles.Tiles.of(of(spark, b), 3))
    np.testing.assert_allclose(back(got.frame()), a @ b, atol=1e-12)
    x, g = R.normal(size=(2, 5, 4)), R.normal(size=(2, 5, 3))
    np.testing.assert_allclose(back(tiles.weight_gradient(of(spark, x), of(spark, g), 3)), np.einsum("abi,abj->ij", x, g), atol=1e-12)
    rows = R.normal(size=(11, 7))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id bigint, x array<double>").repartition(3)
    t = tiles.Tiles.of_rows(df, "id", "x", (11, 7), 4)
    np.testing.assert_array_equal(back(t.frame()), rows)
    np.testing.assert_allclose(back(tiles.matmul(t, t, transpose_a=True).frame()), rows.T @ rows, atol=1e-12)


def test_wrong_shapes(spark):
    a = tiles.Tiles.of(of(spark, R.normal(size=(2, 3))), 2)
    with pytest.raises(ShapeError):
        tiles.matmul(a, a)
    with pytest.raises(ConfigError):
        tiles.matmul(a, tiles.Tiles(a.df, a.shape, 4), transpose_b=True)
    with pytest.raises(ShapeError):
        tiles.Tiles(a.df, (3,))
    holes = TensorFrame(of(spark, R.normal(size=(3, 3))).df.where("i0 != 1 OR i1 != 1"), (3, 3))
    with pytest.raises(Exception, match="has 3"):
        tiles.Tiles.of(holes, 2).df.collect()


def brute(q, k, v, tq, tk, causal, scale, heads, groups):
    out = []
    for x, t in zip(q, tq):
        row = []
        for h in range(heads):
            g, w, d = h * groups // heads, len(x) // heads, v.shape[1] // groups
            s = k[:, g * w : (g + 1) * w] @ x[h * w : (h + 1) * w] * scale
            s = np.where(tk <= t, s, -np.inf) if causal else s
            e = np.exp(s - s.max())
            row.append(e @ v[:, g * d : (g + 1) * d] / e.sum())
        out.append(np.concatenate(row))
    return out


@pytest.mark.parametrize("causal,chunk,heads,groups", [(True, 4, 4, 2), (False, 4, 2, 2), (True, 64, 2, 1), (True, 1, 1, 1)])
def test_attention(spark, causal, chunk, heads, groups):
    """Sequences of several lengths, with a null key, gaps in t, and other columns."""
    own, rows = {}, []
    for key, n in (("a", 11), (None, 9), ("b", 1)):
        t = np.sort(R.choice(30, n, replace=False))
        own[key] = t, R.normal(size=(n, heads * 2)), R.normal(size=(n, groups * 2)) * 30, R.normal(size=(n, groups * 3))
        rows += [(key, int(x), *(c[i].tolist() for c in own[key][1:]), f"{key}{x}") for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "k string, t bigint, q array<double>, kk array<double>, v array<double>, i string").repartition(3)
    got = {(r.k, r.t): (r.o, r.i) for r in attention(df, ["k"], "t", "q", "kk", "v", 0.5, causal, heads=heads, groups=groups, chunk=chunk).collect()}
    assert len(got) == len(rows)
    for key, (t, q, k, v) in own.items():
        for x, want in zip(t, brute(q, k, v, t, t, causal, 0.5, heads, groups)):
            np.testing.assert_allclose(got[key, x][0], want, atol=1e-9)
            assert got[key, x][1] == f"{key}{x}"


def test_fewer_rows_than_pairs_of_rows(spark):
    """What is joined falls by the square of the chunk's length."""
    df = spark.range(256).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.array(F.lit(1.0)).alias("q"))
    plan = attention(df, ["k"], "t", "q", "q", "q", 1.0, chunk=64)
    assert plan.count() == 256 and "CartesianProduct" not in plan._jdf.queryExecution().toString()


def test_as_a_strategy(spark):
    from ordinate.operators import contraction

    a, b = R.normal(size=(2, 5, 3)), R.normal(size=(2, 5, 4))
    got = contraction.matmul(of(spark, a), of(spark, b), transpose_a=True, strategy="tiles")
    np.testing.assert_allclose(back(got), np.swapaxes(a, 1, 2) @ b, atol=1e-12)
    np.testing.assert_allclose(back(contraction.weight_gradient(of(spark, a), of(spark, b))), np.einsum("abi,abj->ij", a, b), atol=1e-12)
