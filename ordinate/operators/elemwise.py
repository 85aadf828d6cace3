"""Elementwise operators with broadcasting: an equi-join on the axes that both sides have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shape as S
from ..errors import ShapeError
from ..frame import TensorFrame, axes
from ..functions import scalar

#: Cells of a side that is broadcast at most; its size is known from its shape.
BROADCAST_CELLS = 100_000


def sided(df: DataFrame, cells: int) -> DataFrame:
    """A side of an equi-join: broadcast if it is small, else sorted and merged. Without the hint Spark goes by the size of the files
    that it comes from, which says nothing of the cells that arrays are exploded to, and would broadcast tables of any size."""
    return F.broadcast(df) if cells <= BROADCAST_CELLS else df.hint("merge")


def _side(t: TensorFrame, rank: int, out: S.Shape, prefix: str):
    """t with its axes aligned at the end as prefixed columns, and the axes along which it varies."""
    names, real = axes(rank), []
    columns = [F.col("v").alias(f"{prefix}v")]
    for k, (a, n) in enumerate(zip(t.axes, t.shape)):
        at = names[rank - t.rank + k]
        if n != 1 or out[rank - t.rank + k] == 1:
            columns.append(F.col(a).alias(f"{prefix}{at}"))
            real.append(at)
    return t.df.select(*columns), real


def binary(a: TensorFrame, b: TensorFrame, f: Callable[[Column, Column], Column]) -> TensorFrame:
    """f of the cells that broadcasting puts together."""
    out = S.broadcast(a.shape, b.shape)
    rank = len(out)
    left, la = _side(a, rank, out, "l_")
    right, lb = _side(b, rank, out, "r_")
    common = [x for x in axes(rank) if x in la and x in lb]
    if common or min(a.size, b.size) <= BROADCAST_CELLS:
        left, right = (sided(left, a.size), right) if a.size < b.size else (left, sided(right, b.size))
    on = [F.col(f"l_{x}") == F.col(f"r_{x}") for x in common]
    both = left.join(right, on, "inner") if on else left.crossJoin(right)  # no common axis: the result has all pairs
    at = [F.col(f"l_{x}" if x in la else f"r_{x}").alias(x) for x in axes(rank)]
    return TensorFrame(both.select(*at, f(F.col("l_v"), F.col("r_v")).alias("v")), out)


def add(a: TensorFrame, b: TensorFrame) -> TensorFrame:
    return binary(a, b, lambda x, y: x + y)


def sub(a: TensorFrame, b: TensorFrame) -> TensorFrame:
    return binary(a, b, lambda x, y: x - y)


def mul(a: TensorFrame, b: TensorFrame) -> TensorFrame:
    return binary(a, b, lambda x, y: x * y)


def div(a: TensorFrame, b: TensorFrame) -> TensorFrame:
    return binary(a, b, scalar.fdiv)


def maximum(a: TensorFrame, b: TensorFrame) -> TensorFrame:
    return binary(a, b, F.greatest)


def minimum(a: TensorFrame, b: TensorFrame) -> TensorFrame:
    return binary(a, b, F.least)


def powf(a: TensorFrame, b: TensorFrame) -> TensorFrame:
    return binary(a, b, F.pow)


def greater(a: TensorFrame, b: TensorFrame) -> TensorFrame:
    return binary(a, b, scalar.gt)


def mul_add(a: TensorFrame, b: TensorFrame, c: TensorFrame) -> TensorFrame:
    return add(mul(a, b), c)


def expand(t: TensorFrame, to: S.Shape) -> TensorFrame:
    """t repeated along its axes of length 1 to a shape that it broadcasts to."""
    if S.broadcast(t.shape, tuple(to)) != tuple(to):
        raise ShapeError(f"{t.shape} does not expand to {to}")
    names, before = axes(len(to)), len(to) - t.rank
    df = t.df.select(*[F.col(a).alias(f"_{a}") for a in t.axes], "v")
    for k, (x, n) in enumerate(zip(names, to)):
        if k >= before and t.shape[k - before] == n:
            df = df.withColumn(x, F.col(f"_i{k - before}"))
        else:
            df = df.withColumn(x, F.explode(F.expr(f"sequence(0L, {n - 1}L)")) if n else F.explode(F.expr("array_repeat(0L, 0)")))
    return TensorFrame(df.select(*names, "v"), tuple(to))


def repeat(t: TensorFrame, axis: int, times: int) -> TensorFrame:
    axis = S.axis_of(axis, t.rank)
    if t.shape[axis] != 1:
        raise ShapeError(f"axis {axis} of {t.shape} has more than one element")
    return expand(t, t.shape[:axis] + (times,) + t.shape[axis + 1 :])


def add_all(parts: list[TensorFrame]) -> TensorFrame:
    """The sum of tensors of one shape: a union and a grouped sum, whatever their number."""
    if not parts or any(p.shape != parts[0].shape for p in parts):
        raise ShapeError("a sum needs tensors of one shape")
    df = parts[0].df
    for p in parts[1:]:
        df = df.unionByName(p.df)
    return TensorFrame(df.groupBy(*parts[0].axes).agg(F.sum("v").alias("v")) if parts[0].rank else df.agg(F.sum("v").alias("v")), parts[0].shape)


def dropout(t: TensorFrame, p: float, seed: int) -> TensorFrame:
    return TensorFrame(t.df.withColumn("v", F.col("v") * scalar.keep_mask(t.linear(), p, seed)), t.shape)
