"""Prefix scans and shifts along an axis of a tensor, as windows over the other axes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import shape as S
from ..frame import TensorFrame

_ALL = {"before": Window.unboundedPreceding, "after": Window.unboundedFollowing}


def _window(t: TensorFrame, axis: int):
    axis = S.axis_of(axis, t.rank)
    others = [a for k, a in enumerate(t.axes) if k != axis]
    return Window.partitionBy(*others).orderBy(f"i{axis}")


def _summed(t: TensorFrame, axis: int, first, last) -> TensorFrame:
    w = _window(t, axis).rowsBetween(first, last)
    return TensorFrame(t.df.withColumn("v", F.coalesce(F.sum("v").over(w), F.lit(0.0))), t.shape)


def cumsum(t: TensorFrame, axis: int) -> TensorFrame:
    return _summed(t, axis, _ALL["before"], 0)


def cumsum_exclusive(t: TensorFrame, axis: int) -> TensorFrame:
    return _summed(t, axis, _ALL["before"], -1)


def cumsum_reverse(t: TensorFrame, axis: int) -> TensorFrame:
    return _summed(t, axis, 0, _ALL["after"])


def cumsum_reverse_exclusive(t: TensorFrame, axis: int) -> TensorFrame:
    return _summed(t, axis, 1, _ALL["after"])


def shift_by(t: TensorFrame, axis: int, n: int) -> TensorFrame:
    """Values moved n places on (back if n is negative), zeros in the places that become free.

    Each cell gets another coordinate, those that fall off the end come as the zeros: no sort, no shuffle.
    """
    axis = S.axis_of(axis, t.rank)
    at, size = F.col(f"i{axis}"), t.shape[axis]
    kept = (at + n >= 0) & (at + n < size)
    moved = {f"i{axis}": F.pmod(at + n, F.lit(max(1, size))), "v": F.when(kept, F.col("v")).otherwise(0.0)}
    return TensorFrame(t.df.select(*[moved.get(c, F.col(c)).alias(c) for c in (*t.axes, "v")]), t.shape)


def shift_right(t: TensorFrame, axis: int) -> TensorFrame:
    return shift_by(t, axis, 1)


def shift_left(t: TensorFrame, axis: int) -> TensorFrame:
    return shift_by(t, axis, -1)
