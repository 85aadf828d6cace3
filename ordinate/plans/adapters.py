"""Low-rank adapters and quantization of tensor relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..frame import TensorFrame
from ..functions import arrays
from ..operators import contraction, elemwise


def lora_delta(x: TensorFrame, a: TensorFrame, b: TensorFrame, alpha: float) -> TensorFrame:
    """x A B, scaled by alpha over the rank (the columns of A)."""
    if a.shape[1] < 1:
        raise ConfigError("an adapter of rank 0")
    scale = alpha / a.shape[1]
    return contraction.matmul(contraction.matmul(x, a), b).map(lambda v: v * scale)


def linear(x: TensorFrame, weight: TensorFrame, bias: TensorFrame | None = None, lora: tuple[TensorFrame, TensorFrame, float] | None = None) -> TensorFrame:
    """x W, plus an adapter's part of x, plus a bias."""
    y = contraction.matmul(x, weight)
    if lora is not None:
        y = elemwise.add(y, lora_delta(x, *lora))
    return elemwise.add(y, bias) if bias is not None else y


def merged(weight: TensorFrame, a: TensorFrame, b: TensorFrame, alpha: float) -> tuple[TensorFrame, TensorFrame]:
    """(weight with the adapter in it, zeros for B): merging again changes nothing."""
    scale = alpha / a.shape[1]
    delta = contraction.matmul(a, b).map(lambda v: v * scale)
    return elemwise.add(weight, delta), b.map(lambda _: F.lit(0.0))


def ranges(t: TensorFrame, axis: int | None = None) -> DataFrame:
    """(low, high) of the whole tensor, or of each index c of an axis."""
    spread = [F.min("v").alias("low"), F.max("v").alias("high")]
    return t.df.agg(*spread) if axis is None else t.df.groupBy(F.col(f"i{axis}").alias("c")).agg(*spread)


def moving_ranges(held: DataFrame | None, new: DataFrame, momentum: float = 0.01) -> DataFrame:
    """Observed ranges (low, high) after one more batch; the first is taken as it is."""
    if not 0 <= momentum <= 1:
        raise ConfigError(f"momentum {momentum}")
    if held is None:
        return new
    both = held.select(F.col("low").alias("l0"), F.col("high").alias("h0")).crossJoin(new)  # one row each
    return both.select(((1 - momentum) * F.col("l0") + momentum * F.col("low")).alias("low"), ((1 - momentum) * F.col("h0") + momentum * F.col("high")).alias("high"))


def quantize(t: TensorFrame, bits: int = 8, symmetric: bool = True, axis: int | None = None, observed: DataFrame | None = None) -> TensorFrame:
    """t at the nearest levels, with a scale for the tensor or for each index of an axis."""
    if observed is not None and axis is not None:
        raise ConfigError("observed ranges hold for a whole tensor")
    held = observed if observed is not None else ranges(t, axis)
    scale, zero, least, greatest = arrays.quantizer(F.col("low"), F.col("high"), bits, symmetric)
    levels = F.broadcast(held.withColumns({"_scale": scale, "_zero": zero})) if axis is None else held.withColumns({"_scale": scale, "_zero": zero})
    both = t.df.crossJoin(levels) if axis is None else t.df.join(levels, F.col(f"i{axis}") == F.col("c"))  # one row of levels
    return TensorFrame(both.select(*t.axes, arrays.quantized(F.col("v"), F.col("_scale"), F.col("_zero"), least, greatest).alias("v")), t.shape)


def quantization_error(t: TensorFrame, q: TensorFrame) -> DataFrame:
    return elemwise.sub(t, q).df.agg(F.avg(F.abs("v")).alias("error"))
