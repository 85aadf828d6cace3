"""Gradients against central differences; training, sampling and streaming."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate.errors import AutodiffError, ConfigError
from ordinate.frame import TensorFrame
from ordinate.plans import autodiff as D
from ordinate.plans import sampling, training
from ordinate.streaming.recurrence import recurrence
from ordinate.streaming.run import settled, to_table

X = np.array([[0.3, -0.7, 1.2], [2.0, -1.5, 0.05]])
W = np.array([[0.5, -0.2], [0.1, 0.9], [-0.4, 0.3]])


def of(spark, a):
    a = np.asarray(a, float)
    return TensorFrame.from_data(spark, a.ravel().tolist(), a.shape)


def back(t):
    return np.array(t.to_data()).reshape(t.shape)


CASES = {
    "tanh": (lambda x: D.tanh(x), np.tanh),
    "sigmoid": (lambda x: D.sigmoid(x), lambda x: 1 / (1 + np.exp(-x))),
    "silu": (lambda x: D.silu(x), lambda x: x / (1 + np.exp(-x))),
    "softplus": (lambda x: D.softplus(x), lambda x: np.log1p(np.exp(x))),
    "exp": (lambda x: D.exp(x), np.exp),
    "square": (lambda x: x * x, lambda x: x * x),
    "cumsum": (lambda x: D.cumsum(x, 1) * D.cumsum(x, 1), lambda x: np.cumsum(x, 1) ** 2),
    "softmax": (lambda x: D.softmax(x, 1) * x, lambda x: np.exp(x) / np.exp(x).sum(1, keepdims=True) * x),
    "mean": (lambda x: D.mean_dim(x, 0) * x, lambda x: x.mean(0, keepdims=True) * x),
    "max": (lambda x: D.max_dim(x, 1) * x, lambda x: x.max(1, keepdims=True) * x),
    "parts": (lambda x: D.cat([D.narrow(x, 1, 1, 2), D.flip(x, 1)], 1) * 2.0, lambda x: np.concatenate([x[:, 1:], x[:, ::-1]], 1) * 2),
    "ratio": (lambda x: x / (x * x + 1.0), lambda x: x / (x * x + 1)),
    "matmul": (lambda x: D.tanh(x @ D.Var(of(x.tensor.df.sparkSession, W))), lambda x: np.tanh(x @ W)),
}


@pytest.mark.parametrize("name", CASES)
def test_gradient(spark, name):
    f, g = CASES[name]
    x = D.Var(of(spark, X), "x")
    got = back(D.backward(D.sum_all(f(x)))["x"])
    want, eps = np.zeros_like(X), 1e-6
    for i in np.ndindex(X.shape):
        d = np.zeros_like(X)
        d[i] = eps
        want[i] = (g(X + d).sum() - g(X - d).sum()) / (2 * eps)
    np.testing.assert_allclose(got, want, atol=1e-4)


def test_gradient_rules(spark):
    x = D.Var(of(spark, [1.0, 2.0]), "x")
    np.testing.assert_allclose(back(D.backward(D.sum_all(D.clamp(x, 1.0, 3.0)))["x"]), [0, 1])
    np.testing.assert_allclose(back(D.backward(D.sum_all(D.round_straight_through(x) * 3.0))["x"]), [3, 3])
    y = D.Var(of(spark, [1.0, 5.0]), "y")
    grads = D.backward(D.sum_all(D.maximum(x, y)))
    np.testing.assert_allclose(back(grads["x"]), [0, 0])
    np.testing.assert_allclose(back(grads["y"]), [1, 1])
    with pytest.raises(AutodiffError):
        D.backward(D.sum_all(x.detach()))
    with D.no_grad():
        assert not D.tanh(x).tracked


def rows(spark, values, g=None):
    return spark.createDataFrame([("w", i, float(v)) for i, v in enumerate(values)], "param string, idx bigint, v double")


def test_adamw_descends(spark):
    params = training.parameters(rows(spark, [0.0] * 4), rank=1)
    trainer = training.Trainer(
        training.AdamW(),
        lambda p, b: p.select("param", "idx", (2 * (F.col("v") - 3)).alias("g")),
        lambda p, b: p.agg(F.avg((F.col("v") - 3) ** 2).alias("loss")),
        settled, learning_rate=0.5, max_norm=0.0,
    )
    for _ in range(12):
        params = trainer.step(params, [params])
    assert trainer.losses[-1] < 0.3 * trainer.losses[0]
    with pytest.raises(ConfigError):
        trainer.step(params, [])


def test_clip_and_schedules(spark):
    grads = spark.createDataFrame([("a", 0, 3.0), ("a", 1, 4.0)], "param string, idx bigint, g double")
    norm = training.gradient_norm(grads).first().norm
    assert norm == 5
    one = spark.range(1)
    f = lambda *a: one.select(training.clip_factor(F.lit(a[0]), a[1], a[2])).first()[0]
    assert abs(f(5.0, 1.0, 1.0) * 5 - 1) < 1e-5 and f(0.01, 1.0, 0.25) == 0.25 and f(3.0, 0.0, 0.5) == 0.5 and f(math.nan, 1.0, 0.5) == 0.5
    s = training.Schedule.cosine(200)
    at = lambda k: one.select(s.at(1.0, F.lit(k))).first()[0]
    assert abs(at(1) - 0.25) < 1e-9 and abs(at(4) - 1) < 1e-9 and abs(at(200) - 0.1) < 1e-9


def test_frozen(spark):
    p = training.parameters(rows(spark, [1.0]))
    assert not training.frozen(p, ["w"]).first().trainable and training.frozen(p, ["q"]).first().trainable and not training.frozen(p, []).first().trainable


def test_sampler(spark):
    z = spark.createDataFrame([(s, k, float(v)) for s in range(50) for k, v in enumerate([0, 10, 0, 9, 0])], "seq bigint, token bigint, logit double")
    drawn = {r.token for r in sampling.Sampler(top_k=2).sample(z, 1).collect()}
    assert drawn <= {1, 3} and len(drawn) == 2
    ties = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "seq bigint, token bigint, logit double")
    assert sampling.Sampler(temperature=0).sample(ties, 0).first().token == 1
    history = spark.createDataFrame([(0, 1), (0, 1)], "seq bigint, token bigint")
    p = {r.token: r.logit for r in sampling.Sampler(repetition_penalty=2.0).penalised(ties, history).collect()}
    assert p == {0: 1.0, 1: 0.25}
    with pytest.raises(ConfigError):
        sampling.Sampler(top_p=0)


def test_generate(spark):
    counts = spark.createDataFrame([(0, 1, 5.0), (1, 2, 5.0), (2, 3, 5.0), (3, 0, 5.0)], "token bigint, next bigint, n double")
    prompts = spark.createDataFrame([(7, 0, 0), (8, 0, 2)], "seq bigint, pos bigint, token bigint")
    out = sampling.generate(prompts, sampling.bigram_logits(counts), sampling.Sampler(temperature=0), settled, most=3, eos=3)
    got = {s: [r.token for r in sorted(out.where(F.col("seq") == s).collect(), key=lambda r: r.pos)] for s in (7, 8)}
    assert got == {7: [0, 1, 2, 3], 8: [2, 3]}
    with pytest.raises(ConfigError):
        sampling.generate(prompts.limit(0), sampling.bigram_logits(counts), sampling.Sampler(), settled)


def test_stream_is_the_batch(spark, sf_dir, tmp_path):
    """Files that arrive one after another, in order of time, give what one pass gives; a late row changes nothing."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.toPandas().sort_values("ts")
    import os

    for k in range(3):
        part = spark.createDataFrame(rows.iloc[k * len(rows) // 3 : (k + 1) * len(rows) // 3], events.schema)
        part.coalesce(1).write.parquet(f"{tmp_path}/p{k}")
        name = next(f for f in os.listdir(f"{tmp_path}/p{k}") if f.endswith(".parquet"))
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.rename(f"{tmp_path}/p{k}/{name}", f"{tmp_path}/in/{k}.parquet")
        os.utime(f"{tmp_path}/in/{k}.parquet", (1e9 + k, 1e9 + k))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r.event_id: r.h for r in to_table(recurrence(stream, -0.1, 0.5, [0.5, 0.5])).collect()}
    from ordinate import catalog

    want = catalog._scalar_scan(spark, sf_dir)
    from ordinate.operators import sequence

    want = {r.event_id: r.h[0] for r in sequence.scan(want, ["user_id"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * (1 + abs(want[k])) for k in want)
