"""Merging of all adapters, discretisation, reversed bands in graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate.errors import ConfigError
from ordinate.frame import TensorFrame
from ordinate.operators import sequence
from ordinate.plans import adapters, autodiff, blocks

R = np.random.default_rng(0)


def of(spark, a):
    return TensorFrame.from_data(spark, np.ravel(a).tolist(), np.shape(a))


def back(t):
    return np.array(t.to_data()).reshape(t.shape)


def test_merged_adapters(spark):
    """Merging changes no output, and merging again changes nothing."""
    arrays = {"one": R.normal(size=(4, 3)), "one.lora_a": R.normal(size=(4, 2)), "one.lora_b": R.normal(size=(2, 3)), "two": R.normal(size=(3, 3))}
    parameters = {k: of(spark, v) for k, v in arrays.items()}
    once = blocks.merged_adapters(parameters, 4.0)
    want = arrays["one"] + 2.0 * arrays["one.lora_a"] @ arrays["one.lora_b"]
    np.testing.assert_allclose(back(once["one"]), want, atol=1e-9)
    np.testing.assert_array_equal(back(once["one.lora_b"]), np.zeros((2, 3)))
    np.testing.assert_array_equal(back(once["two"]), arrays["two"])
    np.testing.assert_allclose(back(blocks.merged_adapters(once, 4.0)["one"]), want, atol=1e-9)


def test_quantized_linear(spark):
    x, w, bias = R.normal(size=(5, 4)), R.normal(size=(4, 3)), R.normal(size=(3,))
    a, b = R.normal(size=(4, 2)), R.normal(size=(2, 3))
    level = lambda v, s: np.round(v / s) * s
    want = level(x, np.abs(x).max() / 127) @ level(w, np.abs(w).max(0) / 127)
    np.testing.assert_allclose(back(blocks.quantized_linear(of(spark, x), of(spark, w), bias=of(spark, bias))), want + bias, atol=1e-9)
    with_adapter = blocks.quantized_linear(of(spark, x), of(spark, w), lora=(of(spark, a), of(spark, b), 4.0))
    np.testing.assert_allclose(back(with_adapter), want + 2.0 * x @ a @ b, atol=1e-9)
    held = spark.createDataFrame([(-2.0, 2.0)], "low double, high double")
    wide = blocks.quantized_linear(of(spark, x), of(spark, w), observed=held)
    clipped = np.clip(np.round(x / (2 / 127)), -127, 127) * 2 / 127
    np.testing.assert_allclose(back(wide), clipped @ level(w, np.abs(w).max(0) / 127), atol=1e-9)
    assert adapters.quantization_error(of(spark, x), of(spark, x)).first().error == 0


def test_discretised(spark):
    df = spark.createDataFrame([(0.3, -1.0), (-2.0, 0.5)], "d double, l double")
    soft, sig = lambda v: np.log1p(np.exp(v)), lambda v: 1 / (1 + np.exp(-v))
    for raw, fixed in ((F.col("l"), None), (None, 1.0), (None, 0.5)):
        dt, lam = sequence.discretised(F.col("d"), 0.7, raw, fixed)
        got = df.select("d", "l", dt.alias("dt"), lam.alias("lam")).collect()
        np.testing.assert_allclose([[r.dt, r.lam] for r in got], [[soft(r.d + 0.7), sig(r.l) if fixed is None else fixed] for r in got])
    for wrong in ((None, None), (F.col("l"), 1.0)):
        with pytest.raises(ConfigError):
            sequence.discretised(F.col("d"), 0.0, *wrong)


def test_reversed_bands_have_reversed_gradients(spark):
    x, g = R.normal(size=(5, 6)), R.normal(size=(5, 6))
    bands = [(0, 2), (4, 5)]
    v = autodiff.Var(of(spark, x), "x")
    y = autodiff.reverse_bands(v, 0, bands)
    want = x.copy()
    for start, end in bands:
        want[:, start:end] = x[::-1, start:end]
    np.testing.assert_array_equal(back(y.tensor), want)
    got = back(autodiff.backward(autodiff.sum_all(autodiff.mul(y, autodiff.Var(of(spark, g)))))["x"])
    want = g.copy()
    for start, end in bands:
        want[:, start:end] = g[::-1, start:end]
    np.testing.assert_allclose(got, want, atol=1e-12)
