"""Generation with a state a sequence, against the relational sampler and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate.errors import ConfigError
from ordinate.plans import sampling

R = np.random.default_rng(3)


@pytest.mark.parametrize("how", [{"temperature": 0}, {"top_k": 3}, {"top_p": 0.6, "temperature": 0.8}, {"top_k": 5, "top_p": 0.9, "repetition_penalty": 1.7}])
def test_drawn_as_sampled(spark, how):
    """A draw from an array is the draw from a relation, ties and penalties included."""
    sampler = sampling.Sampler(**how)
    rows = [(k, np.round(R.normal(size=12), 1).tolist(), R.integers(0, 3, 12).tolist()) for k in range(150)]
    df = spark.createDataFrame(rows, "seq bigint, z array<double>, counts array<int>")
    got = {r.seq: r.token for r in df.select("seq", sampler.drawn("z", 7, 2, "counts").alias("token")).collect()}
    logits = df.select("seq", F.posexplode("z").alias("token", "logit"))
    history = df.select("seq", F.posexplode("counts").alias("token", "n")).select("seq", F.explode(F.array_repeat("token", F.col("n"))).alias("token"))
    assert got == {r.seq: r.token for r in sampler.sample(logits, 7, 2, history).collect()}


@pytest.mark.parametrize("penalty,eos", [(1.0, None), (1.5, None), (1.0, 2)])
def test_generation_against_a_loop(spark, penalty, eos):
    vectors, readout = R.normal(size=(6, 4)), R.normal(size=(6, 4))
    model, sampler = sampling.ScanModel(vectors, readout, 0.7), sampling.Sampler(temperature=0, repetition_penalty=penalty)
    prompts = {k: R.integers(0, 6, R.integers(1, 9)).tolist() for k in range(20)}
    df = spark.createDataFrame([(k, i, t) for k, p in prompts.items() for i, t in enumerate(p)], "seq bigint, pos bigint, token bigint").repartition(3)
    found = sampling.generate_with_state(model.prefill(df, penalty != 1), model.advance, sampler, most=5, eos=eos).collect()
    want = []
    for k, tokens in prompts.items():
        h, seen = np.zeros(4), list(tokens)
        for t in tokens:
            h = 0.7 * h + vectors[t]
        for _ in range(5):
            z = readout @ h
            power = penalty ** np.array([seen.count(t) for t in range(6)], float)
            t = int(np.argmax(np.where(z > 0, z / power, z * power)))
            want.append((k, len(seen), t))
            seen.append(t)
            h = 0.7 * h + vectors[t]
            if t == eos:
                break
    assert sorted(map(tuple, found)) == sorted(want)


def test_edges(spark):
    model = sampling.ScanModel(np.eye(3), np.eye(3), 0.5)
    none = spark.createDataFrame([], "seq bigint, pos bigint, token bigint")
    assert sampling.generate_with_state(model.prefill(none), model.advance, sampling.Sampler(), most=2).collect() == []
    assert sampling.generate_with_state(model.prefill(none), model.advance, sampling.Sampler(), most=0).collect() == []
    with pytest.raises(ConfigError):
        sampling.generate_with_state(model.prefill(none), model.advance, sampling.Sampler(repetition_penalty=2.0))
    for wrong in ((np.eye(3), np.eye(2), 0.5), (np.eye(3), np.eye(3), 1.0)):
        with pytest.raises(ConfigError):
            sampling.ScanModel(*wrong)
