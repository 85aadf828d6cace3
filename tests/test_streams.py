"""Attention and the whole recurrence on streams, against the batch operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate.errors import ConfigError
from ordinate.operators import packed, sequence
from ordinate.streaming import stateful

HOW = {"theta": "theta", "skip": 0.5, "rank": 2}


@pytest.fixture
def small(spark):
    """Batches of three rows, so that a trigger's rows of a key come in many."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield spark
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def numbers(rng, *shape):
    return rng.normal(size=shape).tolist()


def test_attention_goes_on_with_what_it_has_seen(small, monkeypatch):
    """Rows in any order, null keys, several pieces, late rows; the same as one batch."""
    monkeypatch.setattr(stateful, "PIECE", 2)
    rng = np.random.default_rng(1)
    rows = [(k, i, t, numbers(rng, 8), numbers(rng, 4), numbers(rng, 2)) for k in (7, None) for i in ("a", "") for t in range(9)]
    df = small.createDataFrame(rows, "k bigint, i string, t bigint, q array<double>, k_ array<double>, v array<double>").repartition(3)
    late = df.where("i = 'a' AND t = 2")
    how = {"heads": 4, "groups": 2}
    parts = [df.where("t < 3"), df.where("t IN (3, 4, 5)"), df.where("t > 5").union(late)]
    found = stateful.in_parts(parts, lambda s: stateful.attention(s, ["k", "i"], "t", "q", "k_", "v", 0.7, **how)).collect()
    want = {(r.k, r.i, r.t, tuple(np.round(r.o, 9))) for r in sequence.attention(df, ["k", "i"], "t", "q", "k_", "v", 0.7, chunk=4, **how).collect()}
    assert {(r.k, r.i, r.t, tuple(np.round(r.o, 9))) for r in found if not r.late} == want
    assert sorted((str(r.k), r.i, r.t, r.o) for r in found if r.late) == [("7", "a", 2, None), ("None", "a", 2, None)]
    with pytest.raises(ConfigError):
        stateful.attention(df, ["k"], "t", "q", "k_", "v", 1.0, heads=3, groups=2)


def test_steps_go_on_from_a_batch(small, monkeypatch):
    """The first rows by a batch scan, the rest as a stream in two parts, out of order; a key that the batch lacks; late rows."""
    monkeypatch.setattr(stateful, "PIECE", 2)
    rng = np.random.default_rng(2)
    rows = [(k, t, numbers(rng, 2, 3), numbers(rng, 2, 4), numbers(rng, 2, 4), *rng.uniform(0.1, 0.9, 2).tolist(), -float(rng.uniform(0.1, 1)), float(rng.normal())) for k in ("a", "b", "c") for t in range(20)]
    two = "array<array<double>>"
    df = small.createDataFrame(rows, f"k string, t bigint, x {two}, b {two}, c {two}, dt double, lam double, rate double, theta double").repartition(3)
    want = {(r.k, r.t): np.array(r.y) for r in packed.scan(df, ["k"], **HOW).collect()}
    first = packed.scan(df.where("t < 6 AND k != 'c'"), ["k"], **HOW)
    rest = df.where("t >= 6 OR k = 'c'")
    parts = [rest.where("t < 15"), rest.where("t >= 15").union(df.where("t = 3"))]
    found = stateful.in_parts(parts, lambda s: stateful.steps(s, ["k"], state=stateful.last_states(first, ["k"]), most=2, **HOW)).collect()
    on_time = {(r.k, r.t): np.array(r.y) for r in found if not r.late}
    assert on_time.keys() == {(r.k, r.t) for r in rest.collect()}
    assert all(np.allclose(y, want[k], atol=1e-9) for k, y in on_time.items())
    assert sorted((r.k, r.t, r.y) for r in found if r.late) == [("a", 3, None), ("b", 3, None), ("c", 3, None)]


def test_plain_steps(spark):
    """Without angles, ranks and a state to begin with."""
    rng = np.random.default_rng(3)
    rows = [(k, t, numbers(rng, 2), numbers(rng, 3), numbers(rng, 3), 0.3, 0.5, -0.4) for k in (1, 2) for t in range(7)]
    df = spark.createDataFrame(rows, "k int, t bigint, x array<double>, b array<double>, c array<double>, dt double, lam double, rate double")
    want = {(r.k, r.t): r.y for r in sequence.scan(df, ["k"], chunk=3).collect()}
    found = {(r.k, r.t): r.y for r in stateful.in_parts([df.where("t < 4"), df.where("t >= 4")], lambda s: stateful.steps(s, ["k"])).collect()}
    assert found.keys() == want.keys() and all(np.allclose(found[k], want[k], atol=1e-9) for k in want)
    assert spark.conf.get(stateful.PROVIDER) != stateful.ROCKSDB
    with pytest.raises(ConfigError):
        stateful.steps(df.withColumn("z", F.lit(1)), ["k"], rank=0)


def test_steps_read_a_state_by_one_call():
    """A key's state is read once a trigger, whether there is one or not; each call is a round trip."""

    class State:
        def __init__(self, held):
            self.held, self.calls = held, []

        def get(self):
            self.calls.append("get")
            return self.held

        def exists(self):
            self.calls.append("exists")
            return self.held is not None

        def update(self, value):
            self.calls.append("update")
            self.held = value

    run = stateful._Steps(["key0_"], None, False, 0.0, 10)
    run.state, run.ordered = State(None), lambda rows: iter(rows)
    row = [np.array(v, float) for v in ([1], [1], [1], [0.5], [1], [-1], [0])]
    frames = [pd for t in (0, 1) for pd in run.handleInputRows(("=a",), [(t, row)], None)]
    assert run.state.calls == ["get", "update"] * 2 and [f["t"].tolist() for f in frames] == [[0], [1]]
    assert np.isclose(frames[1]["y"][0][0], 0.5 * np.exp(-0.5) + 0.5)
