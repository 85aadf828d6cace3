"""Reductions along axes. A reduced axis stays with length 1; argmax drops it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import shape as S
from ..errors import ShapeError
from ..frame import TensorFrame, axes

#: Value of an axis without elements, by reduction.
EMPTY = {"sum": 0.0, "max": float("-inf"), "min": float("inf"), "prod": 1.0}
_AGG = {"sum": F.sum, "max": F.max, "min": F.min, "prod": F.product}


def reduced(t: TensorFrame, axis: int, kind: str, scale: float = 1.0) -> TensorFrame:
    axis = S.axis_of(axis, t.rank)
    out = t.shape[:axis] + (1,) + t.shape[axis + 1 :]
    if not t.shape[axis]:
        return TensorFrame.generated(t.df.sparkSession, out, lambda *_: F.lit(EMPTY[kind] * scale))
    kept = [a for k, a in enumerate(t.axes) if k != axis]
    v = _AGG[kind]("v")
    df = t.df.groupBy(*kept).agg((v * scale if scale != 1 else v).alias("v"))
    return TensorFrame(df.withColumn(f"i{axis}", F.lit(0).cast("bigint")).select(*t.axes, "v"), out)


def sum_dim(t: TensorFrame, axis: int, scale: float = 1.0) -> TensorFrame:
    return reduced(t, axis, "sum", scale)


def max_dim(t: TensorFrame, axis: int, scale: float = 1.0) -> TensorFrame:
    return reduced(t, axis, "max", scale)


def min_dim(t: TensorFrame, axis: int, scale: float = 1.0) -> TensorFrame:
    return reduced(t, axis, "min", scale)


def prod_dim(t: TensorFrame, axis: int, scale: float = 1.0) -> TensorFrame:
    return reduced(t, axis, "prod", scale)


def mean_dim(t: TensorFrame, axis: int) -> TensorFrame:
    return reduced(t, axis, "sum", 1 / max(1, t.shape[S.axis_of(axis, t.rank)]))


def sum_all(t: TensorFrame) -> TensorFrame:
    if not t.size:
        raise ShapeError("the sum of an empty tensor")
    return TensorFrame(t.df.agg(F.sum("v").alias("v")), ())


def mean_all(t: TensorFrame) -> TensorFrame:
    return sum_all(t).map(lambda v: v / t.size)


def sum_squares(t: TensorFrame) -> TensorFrame:
    return sum_all(t.map(lambda v: v * v))


def value_range(t: TensorFrame) -> tuple[float, float]:
    r = t.df.agg(F.min("v"), F.max("v")).first()
    return r[0], r[1]


def argmax(t: TensorFrame, axis: int) -> TensorFrame:
    """The first index of the maximum along an axis, which goes; NaN wins only from the first place."""
    axis = S.axis_of(axis, t.rank)
    kept = [a for k, a in enumerate(t.axes) if k != axis]
    at: Column = F.col(f"i{axis}")
    key = F.when(F.isnan("v"), F.when(at == 0, float("inf")).otherwise(float("-inf"))).otherwise(F.col("v"))
    df = t.df.groupBy(*kept).agg(F.min(F.struct((-key).alias("k"), at.alias("i"))).alias("best"))
    named = [F.col(a).alias(b) for a, b in zip(kept, axes(len(kept)))]
    return TensorFrame(df.select(*named, F.col("best.i").cast("double").alias("v")), t.shape[:axis] + t.shape[axis + 1 :])


def reduce_to(t: TensorFrame, shape: S.Shape) -> TensorFrame:
    """The sum of t over the axes along which shape was broadcast to t's: one grouped sum."""
    before = t.rank - len(shape)
    if before < 0 or S.broadcast(t.shape, shape) != t.shape:
        raise ShapeError(f"{shape} does not broadcast to {t.shape}")
    if t.shape == shape:
        return t
    kept = [k for k in range(len(shape)) if shape[k] == t.shape[before + k]]
    df = t.df.groupBy(*[F.col(f"i{before + k}").alias(f"_{k}") for k in kept]).agg(F.sum("v").alias("v"))
    named = [(F.col(f"_{k}") if k in kept else F.lit(0).cast("bigint")).alias(f"i{k}") for k in range(len(shape))]
    return TensorFrame(df.select(*named, "v"), tuple(shape))
