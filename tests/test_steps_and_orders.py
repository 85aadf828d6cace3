"""Keyed permutations, moving ranges of streams, step reports and written gradients."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate.errors import ConfigError
from ordinate.frame import TensorFrame
from ordinate.functions.permutation import Permutation, next_index
from ordinate.plans import adapters, autodiff, blocks, training
from ordinate.streaming import ranges
from ordinate.streaming.run import settled


@pytest.mark.parametrize("n,seed", [(1, 0), (2, 1), (7, 1), (97, 2), (1000, 3), (4099, 4)])
def test_permutation(spark, n, seed):
    p = Permutation(n, seed)
    rows = spark.range(n).select("id", p.forward(F.col("id")).alias("at")).withColumn("back", p.inverse(F.col("at"))).collect()
    assert sorted(r["at"] for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    if n > 90:
        assert abs(np.corrcoef([r.id for r in rows], [r["at"] for r in rows])[0, 1]) < 0.3


def test_permutation_of_large_numbers_and_others(spark):
    p = Permutation((1 << 59) + 12345, 3)
    given = [0, 1 << 58, (1 << 59) + 12344, (1 << 59) + 12345, -1, None]
    rows = spark.createDataFrame([(x,) for x in given], "id bigint").select("id", p.forward(F.col("id")).alias("at")).withColumn("back", p.inverse(F.col("at"))).collect()
    assert [r.back for r in rows] == [*given[:3], None, None, None] and len({r["at"] for r in rows[:3]}) == 3
    with pytest.raises(ConfigError):
        Permutation(0, 1)
    drawn = [r.i for r in spark.range(2000).select(next_index(F.col("id"), 7, 5).alias("i")).collect()]
    assert set(drawn) == set(range(7)) and drawn == [r.i for r in spark.range(2000).repartition(3).orderBy("id").select(next_index(F.col("id"), 7, 5).alias("i")).collect()]


def test_shuffled_ids(spark):
    ids = TensorFrame.from_data(spark, [float(k) for k in range(50)], (50,))
    once, again = blocks.shuffled(ids, 4), blocks.shuffled(TensorFrame(ids.df.repartition(3), (50,)), 4)
    assert once.to_data() == again.to_data() != ids.to_data() and sorted(once.to_data()) == ids.to_data()
    assert "Exchange" not in once.df._jdf.queryExecution().executedPlan().toString()


def test_moving_range_is_the_batch_fold_and_a_batch_may_run_again(spark, tmp_path):
    parts = [[3.0, -1.0, None], [5.0, float("nan"), 2.0], [], [10.0, -4.0]]
    base = f"file://{tmp_path}"
    run = lambda: ranges.observe(spark.readStream.schema("v double").parquet(f"{base}/in"), "v", f"{base}/out", f"{base}/log").awaitTermination()
    held = None
    for values in parts:
        spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).write.mode("append").parquet(f"{base}/in")
        run()
        good = [v for v in values if v is not None and v == v]
        if good:
            held = adapters.moving_ranges(held, spark.createDataFrame([(min(good), max(good))], "low double, high double"), 0.3)
    want, got = held.first(), ranges.moving(ranges.pairs(spark, f"{base}/out"), 0.3).first()
    assert (got.low, got.high, got.batches) == (pytest.approx(want.low), pytest.approx(want.high), 3)
    last = max((f for f in os.listdir(tmp_path / "log" / "commits") if f.isdigit()), key=int)
    os.remove(tmp_path / "log" / "commits" / last)
    (tmp_path / "log" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    run()
    assert tuple(ranges.moving(ranges.pairs(spark, f"{base}/out"), 0.3).first()) == tuple(got)
    assert ranges.moving(ranges.pairs(spark, f"{base}/out").limit(0)).collect() == []
    with pytest.raises(ConfigError):
        ranges.moving(held, 2.0)


def test_reports_of_steps(spark):
    """Losses and norms come with the jobs that write gradients and parameters; two batches to a step."""
    seen = []
    trainer = training.Trainer(
        training.Sgd(), lambda p, b: p.crossJoin(b).select("param", "idx", (2 * (F.col("v") - F.col("to"))).alias("g")),
        lambda p, b: p.crossJoin(b).agg(F.sum((F.col("v") - F.col("to")) ** 2).alias("loss")), settled, training.Schedule("step", gamma=0.5, every=2),
        learning_rate=0.1, max_norm=1.0, accumulation=2, on_step=seen.append, log_every=2,
    )
    params = training.parameters(spark.createDataFrame([("w", 0, 3.0), ("w", 1, 0.0)], "param string, idx bigint, v double"))
    batch = lambda to: spark.createDataFrame([(to,)], "to double")
    params = trainer.fit(params, [batch(0.0), batch(1.0)] * 3)
    w, rate = np.array([3.0, 0.0]), 0.1
    for k, info in enumerate(trainer.report.steps, 1):
        g = np.mean([2 * (w - to) for to in (0.0, 1.0)], 0)
        norm = np.linalg.norm(g)
        assert (info.number, info.loss, info.norm) == (k, pytest.approx(np.mean([((w - to) ** 2).sum() for to in (0.0, 1.0)])), pytest.approx(norm))
        assert info.factor == pytest.approx(min(1, 1 / (norm + 1e-6)) / 2)
        w = w - info.rate * min(1, 1 / (norm + 1e-6)) * g
    np.testing.assert_allclose([r.v for r in params.orderBy("idx").collect()], w)
    assert [s.number for s in seen] == [2] and trainer.report.final_loss == trainer.losses[-1] and trainer.report.table(spark).count() == 3
    assert trainer.evaluate(params, []) == 0.0


def test_written_gradients_are_the_same_with_small_plans(spark):
    x = np.random.default_rng(1).normal(size=(4, 3))
    of = lambda: autodiff.Var(TensorFrame.from_data(spark, x.ravel().tolist(), (4, 3)), "x")
    f = lambda v: autodiff.sum_all(autodiff.softmax(autodiff.tanh(v * v), 1) * v)
    reads = lambda t: t.df._jdf.queryExecution().analyzed().collectLeaves().length()
    plain = autodiff.backward(f(of()))["x"]
    with autodiff.written(settled, 3):
        small = autodiff.backward(f(of()))["x"]
    np.testing.assert_allclose(small.to_data(), plain.to_data(), atol=1e-12)
    assert reads(small) <= 6 < reads(plain)
