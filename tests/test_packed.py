"""The packed scan and its gradients against a plain loop and central differences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate.errors import ConfigError
from ordinate.operators import packed, sequence

NAMES = ("x", "b", "c", "dt", "lam", "rate", "theta")


def made(rng, n, p, m, rank):
    shape = (rank or 1,)
    return {
        "x": rng.normal(size=(n, *shape, p)), "b": rng.normal(size=(n, *shape, m)), "c": rng.normal(size=(n, *shape, m)), "dt": rng.uniform(0.05, 0.5, n),
        "lam": rng.uniform(0.1, 0.9, n), "rate": -rng.uniform(0.2, 2, n), "theta": rng.uniform(-2, 2, n),
    }


def turned(v, angle):
    half = v.shape[-1] // 2
    return np.concatenate([v[:, :half] * np.cos(angle) + v[:, half:] * np.sin(angle), v[:, half:] * np.cos(angle) - v[:, :half] * np.sin(angle)], 1)


def loop(s, skip, h=None, last=None, angle=0.0):
    """The recurrence, row by row."""
    out = []
    for x, b, c, dt, lam, rate, theta in zip(*(s[k] for k in NAMES)):
        angle += dt * theta
        b, c = turned(b, angle), turned(c, angle)
        u = x.T @ b
        h, last = (np.zeros_like(u), np.zeros_like(u)) if h is None else (h, last)
        a = np.exp(max(-60.0, dt * rate))
        h = a * h + (1 - lam) * dt * a * last + lam * dt * u
        last = u
        out.append(c @ h.T + skip * x)
    return np.array(out), h, last, angle


def frame(spark, keyed, rank, more=None):
    """keyed: (key, start, values) of each sequence."""
    lists = lambda v: v.tolist() if rank else v[0].tolist()
    rows = []
    for key, start, s in keyed:
        for i in range(len(s["dt"])):
            rows.append((key, start + i, *(lists(s[k][i]) if k in ("x", "b", "c") else float(s[k][i]) for k in NAMES), lists(more[key][i]) if more else None))
    kind = "array<array<double>>" if rank else "array<double>"
    return spark.createDataFrame(rows, f"k string, t bigint, x {kind}, b {kind}, c {kind}, dt double, lam double, rate double, theta double, g {kind}").repartition(3)


@pytest.mark.parametrize("rank,chunk,n", [(None, 4, (13, 1, 4)), (2, 3, (11, 5, 2)), (None, 64, (9, 3, 0))])
def test_scan_and_gradients(spark, rank, chunk, n):
    rng = np.random.default_rng(chunk)
    own = {k: made(rng, m, 3, 4, rank) for k, m in zip("abc", n)}
    weights = {k: rng.normal(size=s["x"].shape) for k, s in own.items()}
    df = frame(spark, [(k, 0, s) for k, s in own.items()], rank, weights)
    got = {(r.k, r.t): r for r in packed.scan(df, ["k"], skip=0.3, theta="theta", rank=rank, chunk=chunk).collect()}
    grads = {(r.k, r.t): r for r in packed.gradients(df, ["k"], "g", skip=0.3, theta="theta", rank=rank, chunk=chunk).collect()}
    assert len(got) == len(grads) == sum(n)
    eps = 1e-6
    for k, s in own.items():
        if not len(s["dt"]):
            continue
        y, h, u, angle = loop(s, 0.3)
        np.testing.assert_allclose([np.ravel(got[k, t].y) for t in range(len(y))], y.reshape(len(y), -1), atol=1e-9)
        np.testing.assert_allclose(got[k, len(y) - 1].h, h.ravel(), atol=1e-9)
        np.testing.assert_allclose(got[k, len(y) - 1].u, u.ravel(), atol=1e-9)
        assert abs(np.exp(1j * got[k, len(y) - 1].phi) - np.exp(1j * angle)) < 1e-9
        for name in NAMES:
            for at in np.ndindex(s[name].shape) if name not in ("b", "c") else list(np.ndindex(s[name].shape))[::3]:
                both = []
                for sign in (1, -1):
                    moved = s | {name: s[name].copy()}
                    moved[name][at] += sign * eps
                    both.append((loop(moved, 0.3)[0] * weights[k]).sum())
                found = np.reshape(grads[k, at[0]][f"g{name}"], s[name].shape[1:])[at[1:]]
                assert found == pytest.approx((both[0] - both[1]) / (2 * eps), abs=2e-6), (k, name, at)


def test_resumed_and_plain(spark):
    """A scan goes on from the states of another; without angles it is the other batch scan."""
    rng = np.random.default_rng(5)
    s = {k: made(rng, 12, 2, 4, None) for k in "ab"}
    df = frame(spark, [(k, 0, v) for k, v in s.items()], None)
    how = {"theta": "theta", "skip": -0.2, "chunk": 4}
    first = packed.scan(df.where("t < 5"), ["k"], **how)
    rest = packed.scan(df.where("t >= 5").withColumn("t", F.col("t") - 5), ["k"], state=sequence.final_states(first, ["k"]), **how)
    got = {(r.k, r.t): r.y for r in first.select("k", "t", "y").union(rest.select("k", F.col("t") + 5, "y")).collect()}
    for k, v in s.items():
        np.testing.assert_allclose([got[k, t] for t in range(12)], loop(v, -0.2)[0][:, 0], atol=1e-9)
    plain = {(r.k, r.t): r.y for r in packed.scan(df, ["k"], chunk=5).collect()}
    other = {(r.k, r.t): r.y for r in sequence.scan(df, ["k"], chunk=4).collect()}
    assert plain.keys() == other.keys() and all(np.allclose(plain[k], other[k], atol=1e-9) for k in plain)


def test_edges(spark):
    empty = frame(spark, [], None)
    assert packed.scan(empty, ["k"]).collect() == [] and packed.gradients(empty, ["k"], "g", theta="theta").collect() == []
    null_key = frame(spark, [("x", 0, made(np.random.default_rng(0), 6, 1, 2, None))], None).withColumn("k", F.lit(None).cast("string"))
    assert packed.scan(null_key, ["k"], theta="theta", chunk=2).count() == 6
    for wrong in ({"chunk": 0}, {"rank": 0}):
        with pytest.raises(ConfigError):
            packed.scan(empty, ["k"], **wrong)


def test_gradient_of_a_plain_scan(spark):
    rng = np.random.default_rng(8)
    d, u, g = -rng.uniform(0.1, 1, 11), rng.normal(size=(11, 2)), rng.normal(size=(11, 2))
    rows = [(k, t, float(d[t]), u[t].tolist(), g[t].tolist()) for k in (1, None) for t in range(11)]
    df = spark.createDataFrame(rows, "k int, t bigint, d double, u array<double>, g array<double>").repartition(2)
    got = {(r.k, r.t): r.gu for r in sequence.linear_scan_gradient(df, ["k"], "t", "d", "g", chunk=4).collect()}
    for t in range(11):
        want = sum(g[s] * np.exp(d[t + 1 : s + 1].sum()) for s in range(t, 11))
        np.testing.assert_allclose(got[1, t], want, atol=1e-12)
        np.testing.assert_allclose(got[None, t], want, atol=1e-12)
