"""Operators against numpy on small tensors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate import frame as T
from ordinate.errors import ConfigError, RankError, ShapeError, StateDictError
from ordinate.functions import scalar
from ordinate.operators import contraction, elemwise, indexing, movement, reduce, scan, sequence
from ordinate.plans import adapters
from ordinate.sources import state


def of(spark, a):
    a = np.asarray(a, float)
    return T.TensorFrame.from_data(spark, a.ravel().tolist(), a.shape)


def back(t):
    return np.array(t.to_data()).reshape(t.shape)


A = np.arange(1.0, 7).reshape(2, 3)


def test_broadcast(spark):
    a = of(spark, A)
    np.testing.assert_allclose(back(elemwise.add(a, of(spark, [10, 20, 30]))), A + [10, 20, 30])
    np.testing.assert_allclose(back(elemwise.mul(a, of(spark, [[1], [2]]))), A * [[1], [2]])
    np.testing.assert_allclose(back(elemwise.sub(of(spark, [[1], [2]]), of(spark, [1, 2, 3]))), np.array([[1], [2]]) - [1, 2, 3])
    np.testing.assert_allclose(back(elemwise.expand(of(spark, [[1], [2]]), (2, 2, 3))), np.broadcast_to([[1], [2]], (2, 2, 3)))
    np.testing.assert_allclose(back(elemwise.add_all([a, a, a])), 3 * A)
    with pytest.raises(ShapeError):
        elemwise.add(a, of(spark, [1, 2]))


def test_ieee(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (math.nan, 2.0)], "a double, b double")
    r = df.select(scalar.fdiv(F.col("a"), F.col("b")).alias("q"), scalar.flog(F.col("a")).alias("l"), scalar.gt(F.col("a"), F.lit(0.5)).alias("g")).collect()
    assert [x.q for x in r[:2]] == [math.inf, -math.inf] and math.isnan(r[2].q) and r[3].q == 2
    assert r[0].l == 0 and math.isnan(r[1].l) and r[2].l == -math.inf
    assert [x.g for x in r] == [1, 0, 0, 1, 0]
    half = spark.createDataFrame([(2.5,), (-2.5,), (0.49999999999999994,)], "x double").select(scalar.round_half_away(F.col("x")).alias("r")).collect()
    assert [x.r for x in half][:2] == [3, -3]


def test_reductions_scans(spark):
    a = of(spark, A)
    for f, g in ((reduce.sum_dim, np.sum), (reduce.max_dim, np.max), (reduce.min_dim, np.min), (reduce.prod_dim, np.prod), (reduce.mean_dim, np.mean)):
        for axis in (0, 1, -1):
            np.testing.assert_allclose(back(f(a, axis)), g(A, axis=axis, keepdims=True))
    np.testing.assert_allclose(back(reduce.argmax(of(spark, [[1, 3, 3], [2, 2, 1]]), 1)), [1, 0])
    assert back(reduce.sum_all(a)) == 21
    np.testing.assert_allclose(back(scan.cumsum_exclusive(a, 1)), [[0, 1, 3], [0, 4, 9]])
    np.testing.assert_allclose(back(scan.cumsum_reverse_exclusive(a, 1)), [[5, 3, 0], [11, 6, 0]])
    np.testing.assert_allclose(back(scan.shift_by(a, 1, 5)), np.zeros((2, 3)))
    np.testing.assert_allclose(back(reduce.reduce_to(of(spark, np.ones((4, 2, 3))), (2, 1))), np.full((2, 1), 12.0))
    with pytest.raises(RankError):
        reduce.sum_dim(a, 2)


def test_movement(spark):
    x = np.arange(24.0).reshape(2, 3, 4)
    t = of(spark, x)
    np.testing.assert_allclose(back(movement.permute(t, [2, 0, 1])), x.transpose(2, 0, 1))
    np.testing.assert_allclose(back(movement.flip(t, 1)), x[:, ::-1])
    np.testing.assert_allclose(back(movement.narrow(t, 2, 1, 2)), x[:, :, 1:3])
    np.testing.assert_allclose(back(movement.reshape(t, (4, 6))), x.reshape(4, 6))
    np.testing.assert_allclose(back(movement.cat(movement.split(t, [1, 2], 1)[::-1], 1)), np.concatenate([x[:, 1:], x[:, :1]], 1))
    np.testing.assert_allclose(back(movement.pad(t, 0, 1, 1))[1:3], x)
    banded = x.copy()
    banded[..., 1:3] = x[:, ::-1, 1:3]
    np.testing.assert_allclose(back(movement.reverse_bands(t, 1, [(1, 3)])), banded)
    for bad in (lambda: movement.permute(t, [0, 0, 1]), lambda: movement.narrow(t, 0, 1, 2), lambda: movement.chunk(t, 5, 2), lambda: movement.cat([], 0), lambda: movement.squeeze(t, 0)):
        with pytest.raises(ShapeError):
            bad()


@pytest.mark.parametrize("strategy", ["auto", "broadcast", "shuffle"])
def test_matmul(spark, strategy):
    r = np.random.default_rng(0)
    a, b = r.normal(size=(2, 3, 4)), r.normal(size=(4, 5))
    np.testing.assert_allclose(back(contraction.matmul(of(spark, a), of(spark, b), strategy=strategy)), a @ b)
    np.testing.assert_allclose(back(contraction.matmul_nt(of(spark, a[0]), of(spark, b.T), strategy=strategy)), a[0] @ b)
    np.testing.assert_allclose(back(contraction.matmul_tn(of(spark, a[0].T), of(spark, b), strategy=strategy)), a[0] @ b)


def test_matmul_rows_and_precision(spark):
    r = np.random.default_rng(1)
    a, b = r.normal(size=(7, 4)), r.normal(size=(4, 3))
    np.testing.assert_allclose(back(contraction.matmul(of(spark, a), of(spark, b), strategy="rows")), a @ b)
    low = scalar.to_bfloat16(a).astype(float) @ scalar.to_bfloat16(b).astype(float)
    np.testing.assert_allclose(back(contraction.matmul(of(spark, a), of(spark, b), precision="bfloat16")), low)
    half = a.astype(np.float16).astype(float) @ b.astype(np.float16).astype(float)
    np.testing.assert_allclose(back(contraction.matmul(of(spark, a), of(spark, b), precision="float16")), half)
    np.testing.assert_allclose(back(contraction.weight_gradient(of(spark, a), of(spark, a @ b))), a.T @ a @ b)
    with pytest.raises(ConfigError):
        contraction.matmul(of(spark, a), of(spark, b), precision="int4")


def test_indexing(spark):
    table = of(spark, [[0, 1], [10, 11], [20, 21]])
    ids = spark.createDataFrame([(0, 2), (1, 0), (2, 2)], "at bigint, id bigint")
    got = {(r["at"], r.i1): r.v for r in indexing.gather_rows(table, ids).collect()}
    assert [got[a, j] for a in range(3) for j in range(2)] == [20, 21, 0, 1, 20, 21]
    with pytest.raises(Exception, match="no row 7"):
        indexing.gather_rows(table, spark.createDataFrame([(0, 7)], "at bigint, id bigint")).collect()
    grads = spark.createDataFrame([(i, j, float(g)) for i, g in ((0, 1), (2, 2), (2, 3)) for j in range(2)], "id bigint, i1 bigint, v double")
    np.testing.assert_allclose(back(indexing.scatter_add_rows(grads, 3, 2)), [[1, 1], [0, 0], [5, 5]])
    hot = indexing.one_hot(of(spark, [2, 0, 9]), 3)
    np.testing.assert_allclose(back(hot), [[0, 0, 1], [1, 0, 0], [0, 0, 0]])


def direct(x, b, c, dt, lam, rate, h=None, last=None):
    h = np.zeros((x.shape[1], b.shape[1])) if h is None else h
    last = np.zeros_like(h) if last is None else last
    ys = []
    for t in range(len(x)):
        a, u = math.exp(dt[t] * rate), np.outer(x[t], b[t])
        h = a * h + (1 - lam[t]) * dt[t] * a * last + lam[t] * dt[t] * u
        last = u
        ys.append(h @ c[t])
    return np.array(ys), h, last


def sequences(spark, n, seed=0):
    r = np.random.default_rng(seed)
    data, rows = {}, []
    for k in range(2):
        x, b, c = r.normal(size=(n, 2)), r.normal(size=(n, 3)), r.normal(size=(n, 3))
        dt, lam = r.uniform(0.05, 0.6, n), r.uniform(0, 1, n)
        data[k] = (x, b, c, dt, lam, -0.7 - k)
        rows += [(k, t, x[t].tolist(), b[t].tolist(), c[t].tolist(), float(dt[t]), float(lam[t]), -0.7 - k) for t in range(n)]
    df = spark.createDataFrame(rows, "k bigint, t bigint, x array<double>, b array<double>, c array<double>, dt double, lam double, rate double")
    return data, df


@pytest.mark.parametrize("n,chunk", [(1, 4), (13, 4), (13, 1), (13, 3), (40, 3)])
def test_scan(spark, n, chunk):
    data, df = sequences(spark, n)
    got = {(r.k, r.t): r.y for r in sequence.scan(df, ["k"], chunk=chunk).collect()}
    for k, d in data.items():
        np.testing.assert_allclose([got[k, t] for t in range(n)], direct(*d)[0], atol=1e-9)


@pytest.mark.parametrize("cut", [1, 5, 11])
def test_scan_resumes(spark, cut):
    data, df = sequences(spark, 12, 3)
    first = sequence.scan(df.where(F.col("t") < cut), ["k"], chunk=4)
    rest = df.where(F.col("t") >= cut).withColumn("t", F.col("t") - cut)
    rest = sequence.scan(rest, ["k"], chunk=4, skip=0.3, state=sequence.final_states(first, ["k"]))
    got = {(r.k, r.t): r.y for r in rest.collect()}
    for k, d in data.items():
        want = direct(*d)[0] + 0.3 * d[0]
        np.testing.assert_allclose([got[k, t] for t in range(12 - cut)], want[cut:], atol=1e-9)


def test_positions(spark):
    df = spark.createDataFrame([(k, (7 * i) % 50) for k in ("a", "b", None) for i in range(50)], "k string, o bigint")
    for parts in (None, F.floor(F.col("o") / 7)):
        got = sequence.positions(df, ["k"], ["o"], parts=parts).collect()
        assert len(got) == 150 and all(r.t == r.o for r in got)


def test_conv_history(spark):
    df = spark.createDataFrame([("a", t, float(t * t)) for t in range(9)], "k string, t bigint, x double")
    whole = {r.t: r.y for r in sequence.causal_conv(df, ["k"], "t", "x", [1.0, 2.0, 3.0], 0.5).collect()}
    past = sequence.conv_history(df.where("t < 4"), ["k"], "t", "x", 3)
    rest = df.where("t >= 4").withColumn("t", F.col("t") - 4)
    got = {r.t + 4: r.y for r in sequence.causal_conv(rest, ["k"], "t", "x", [1.0, 2.0, 3.0], 0.5, past).collect()}
    assert all(abs(whole[t] - y) < 1e-9 for t, y in got.items()) and whole[0] == 0.5


def test_dropout(spark):
    ones = T.ones(spark, (4096,))
    v = back(elemwise.dropout(ones, 0.5, 1234))
    assert abs((v > 0).mean() - 0.5) < 0.05 and set(np.unique(v)) == {0.0, 2.0}
    assert back(elemwise.dropout(ones, 1.0, 1)).sum() == 0


def test_adapters(spark):
    r = np.random.default_rng(5)
    x, w, a, b = r.normal(size=(2, 8)), r.normal(size=(8, 6)), r.normal(size=(8, 2)), r.normal(size=(2, 6))
    before = back(adapters.linear(of(spark, x), of(spark, w), lora=(of(spark, a), of(spark, b), 4.0)))
    new, zero = adapters.merged(of(spark, w), of(spark, a), of(spark, b), 4.0)
    np.testing.assert_allclose(back(adapters.linear(of(spark, x), new, lora=(of(spark, a), zero, 4.0))), before, atol=1e-9)
    t = of(spark, (np.arange(64) - 32).reshape(8, 8) / 32)
    q = adapters.quantize(t, bits=4)
    assert len(np.unique(np.round(back(q), 9))) <= 15 and np.abs(back(q) - back(t)).max() <= 1 / 14 + 1e-9


def test_state_dict(spark, tmp_path):
    parts = {"a.weight": of(spark, A), "a.bias": of(spark, [1, 2, 3])}
    s = state.state_dict(spark, parts)
    for form in ("parquet", "json"):
        state.save(s, f"{tmp_path}/{form}", form)
        again = state.tensors(state.load(spark, f"{tmp_path}/{form}", form))
        np.testing.assert_allclose(back(again["a.weight"]), A)
    state.save_checkpoint(s, f"{tmp_path}/c", 7, {"note": "x"})
    loaded, step, meta = state.load_checkpoint(spark, f"{tmp_path}/c")
    assert (step, meta) == (7, {"note": "x"}) and state.value_count(loaded).first()[0] == 9
    assert state.filtered(s, "bias").count() == 1
    with pytest.raises(StateDictError):
        state.loaded(s, state.filtered(s, "bias"))
    assert state.loaded(s, state.filtered(s, "bias"), strict=False).count() == 2


@pytest.mark.parametrize("kind,spread", [("uniform", 3**-0.5), ("normal", 0.02), ("kaiming_uniform", 50**-0.5), ("kaiming_normal", 50**-0.5), ("xavier_uniform", (2 / 90) ** 0.5), ("xavier_normal", (2 / 90) ** 0.5), ("residual", 0.01)])
def test_initial(spark, kind, spread):
    v = back(T.initial(spark, (50, 40), kind, 3, depth=2))
    assert abs(v.mean()) < 0.1 * spread and abs(v.std() / spread - 1) < 0.06
    assert len(np.unique(v)) == v.size and (back(T.initial(spark, (50, 40), kind, 3, depth=2)) == v).all()


def test_mimo(spark):
    r = np.random.default_rng(8)
    n, rank = 9, 2
    x, b, c = r.normal(size=(n, rank, 2)), r.normal(size=(n, rank, 3)), r.normal(size=(n, rank, 3))
    dt, lam = r.uniform(0.05, 0.6, n), r.uniform(0, 1, n)
    rows = [(0, t, x[t].tolist(), b[t].tolist(), c[t].tolist(), float(dt[t]), float(lam[t]), -0.7) for t in range(n)]
    df = spark.createDataFrame(rows, "k bigint, t bigint, x array<array<double>>, b array<array<double>>, c array<array<double>>, dt double, lam double, rate double")
    got = {row.t: row.y for row in sequence.mimo_scan(df, ["k"], rank, chunk=4).collect()}
    for i in range(rank):
        want = sum(direct(x[:, j], b[:, j], c[:, i], dt, lam, -0.7)[0] for j in range(rank))
        np.testing.assert_allclose([got[t][i] for t in range(n)], want, atol=1e-9)


def test_running_sum_and_attention_with_heads(spark):
    r = np.random.default_rng(3)
    n, heads, groups, wide = 13, 4, 2, 3
    q, k, v, x = r.normal(size=(n, heads * wide)), r.normal(size=(n, groups * wide)), r.normal(size=(n, groups * 2)), r.normal(size=n)
    rows = [("a", t, float(x[t]), q[t].tolist(), k[t].tolist(), v[t].tolist()) for t in range(n)]
    df = spark.createDataFrame(rows, "id string, t bigint, x double, q array<double>, k array<double>, v array<double>")
    sums = {row.t: row.s for row in sequence.running_sum(df, ["id"], "t", "x", "s", chunk=4).collect()}
    np.testing.assert_allclose([sums[t] for t in range(n)], np.cumsum(x), atol=1e-12)
    want = np.zeros((n, heads * 2))
    for t in range(n):
        for h in range(heads):
            g = h * groups // heads
            z = k[: t + 1, g * wide : (g + 1) * wide] @ q[t, h * wide : (h + 1) * wide] * 0.3
            p = np.exp(z - z.max())
            want[t, 2 * h : 2 * h + 2] = p / p.sum() @ v[: t + 1, 2 * g : 2 * g + 2]
    how = {"scale": 0.3, "heads": heads, "groups": groups, "chunk": 4}
    got = {row.t: row.o for row in sequence.attention(df, ["id"], "t", "q", "k", "v", **how).collect()}
    np.testing.assert_allclose([got[t] for t in range(n)], want, atol=1e-9)
    late = sequence.attention(df.where("t >= 5"), ["id"], "t", "q", "k", "v", past=df.where("t < 5"), **how)
    np.testing.assert_allclose([row.o for row in late.orderBy("t").collect()], want[5:], atol=1e-9)


def test_edges_of_functions(spark):
    from ordinate.functions import arrays
    from ordinate.plans.training import Schedule

    nan = float("nan")
    df = spark.createDataFrame([([nan, 5.0],), ([1.0, nan, 3.0],), ([2.0, 2.0],)], "x array<double>")
    assert [row[0] for row in df.select(arrays.argmax(F.col("x"))).collect()] == [0, 2, 0]
    assert spark.range(1).select(Schedule("step", every=0).at(0.5, F.col("id"))).first()[0] == 0.5
    xs = [0.0, 1e-9, -0.3, 0.7, 1.9, 2.999, 3.001, -4.5, 8.0, 40.0, float("inf"), float("-inf")]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", scalar.erf(F.col("x")).alias("y")).orderBy("i").collect()
    assert all(abs(row.y - math.erf(x)) < 1e-12 for row, x in zip(got, xs))


def _joins(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("strategy=merge"), plan.count("strategy=broadcast")


def test_large_sides_are_merged_whatever_their_files_say(spark):
    """Cells that arrays are exploded to are many more than the size of a file says: only sides known to be small are broadcast."""
    rows = spark.range(10).select("id", F.array_repeat(F.lit(1.0), 64).alias("x"))
    large, few = (T.TensorFrame.from_rows(rows, ["id"], "x", (n, 64)) for n in (1 << 20, 1))
    assert _joins(elemwise.add(large, large).df) == (1, 0) and _joins(elemwise.add(large, few).df) == (0, 1)
    assert _joins(indexing.gather_rows(large, spark.range(5))) == (1, 0)


def test_shift_sorts_nothing(spark):
    x = T.TensorFrame.generated(spark, (2, 4), lambda i, k: 4 * i + k + 1.0)
    for n, want in ((1, [0, 1, 2, 3, 0, 5, 6, 7]), (-2, [3, 4, 0, 0, 7, 8, 0, 0]), (0, [1, 2, 3, 4, 5, 6, 7, 8]), (9, [0] * 8), (-4, [0] * 8)):
        moved = scan.shift_by(x, 1, n)
        assert moved.to_data() == want
        assert "Window" not in moved.df._jdf.queryExecution().optimizedPlan().toString()
