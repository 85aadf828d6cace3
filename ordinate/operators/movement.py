"""Movement: projections that rename and recompute coordinates, without a shuffle."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import shape as S
from ..errors import ShapeError
from ..frame import TensorFrame, unravelled


def _placed(t: TensorFrame, at: dict[int, Column], shape: S.Shape, where: Column | None = None) -> TensorFrame:
    df = t.df if where is None else t.df.where(where)
    return TensorFrame(df.select(*[at.get(k, F.col(f"i{k}")).cast("bigint").alias(f"i{k}") for k in range(len(shape))], "v"), shape)


def permute(t: TensorFrame, order: list[int]) -> TensorFrame:
    if sorted(order) != list(range(t.rank)):
        raise ShapeError(f"{order} is no permutation of {t.rank} axes")
    return _placed(t, {k: F.col(f"i{a}") for k, a in enumerate(order)}, tuple(t.shape[a] for a in order))


def swap_axes(t: TensorFrame, a: int, b: int) -> TensorFrame:
    order = list(range(t.rank))
    a, b = S.axis_of(a, t.rank), S.axis_of(b, t.rank)
    order[a], order[b] = order[b], order[a]
    return permute(t, order)


def transpose(t: TensorFrame) -> TensorFrame:
    if t.rank < 2:
        raise ShapeError("a transpose needs two axes")
    return swap_axes(t, -2, -1)


def reshape(t: TensorFrame, shape: S.Shape) -> TensorFrame:
    shape = S.checked(shape)
    if prod(shape) != t.size:
        raise ShapeError(f"{t.shape} does not reshape to {shape}")
    df = t.df.select(t.linear().alias("_at"), "v")
    return TensorFrame(df.select(*unravelled(F.col("_at"), shape), "v"), shape)


def unsqueeze(t: TensorFrame, axis: int) -> TensorFrame:
    axis = S.axis_of(axis, t.rank + 1)
    return reshape(t, t.shape[:axis] + (1,) + t.shape[axis:])


def squeeze(t: TensorFrame, axis: int) -> TensorFrame:
    axis = S.axis_of(axis, t.rank)
    if t.shape[axis] != 1:
        raise ShapeError(f"axis {axis} of {t.shape} has more than one element")
    return reshape(t, t.shape[:axis] + t.shape[axis + 1 :])


def flatten(t: TensorFrame) -> TensorFrame:
    return reshape(t, (t.size,))


def flip(t: TensorFrame, axis: int) -> TensorFrame:
    axis = S.axis_of(axis, t.rank)
    return _placed(t, {axis: F.lit(t.shape[axis] - 1) - F.col(f"i{axis}")}, t.shape)


def reverse_bands(t: TensorFrame, axis: int, bands: list[tuple[int, int]]) -> TensorFrame:
    """axis reversed for the cells whose offset within the axes after it lies in one of the bands [start, end)."""
    axis = S.axis_of(axis, t.rank)
    inner = prod(t.shape[axis + 1 :])
    if any(not 0 <= s < e <= inner for s, e in bands):
        raise ShapeError(f"bands {bands} of {inner} offsets")
    offset = F.lit(0).cast("bigint")
    for k, n in zip(range(axis + 1, t.rank), S.strides(t.shape)[axis + 1 :]):
        offset = offset + F.col(f"i{k}") * n
    inside = F.lit(False)
    for s, e in bands:
        inside = inside | ((offset >= s) & (offset < e))
    at = F.col(f"i{axis}")
    return _placed(t, {axis: F.when(inside, F.lit(t.shape[axis] - 1) - at).otherwise(at)}, t.shape)


def narrow(t: TensorFrame, axis: int, start: int, length: int) -> TensorFrame:
    """The range [start, start + length) of an axis."""
    axis = S.axis_of(axis, t.rank)
    if start < 0 or length < 0 or start + length > t.shape[axis]:
        raise ShapeError(f"[{start}, {start + length}) of axis {axis} of {t.shape}")
    at = F.col(f"i{axis}")
    shape = t.shape[:axis] + (length,) + t.shape[axis + 1 :]
    return _placed(t, {axis: at - start}, shape, (at >= start) & (at < start + length))


def cat(parts: list[TensorFrame], axis: int) -> TensorFrame:
    if not parts:
        raise ShapeError("nothing to concatenate")
    axis, at, out = S.axis_of(axis, parts[0].rank), 0, None
    for p in parts:
        if p.rank != parts[0].rank or any(k != axis and n != m for k, (n, m) in enumerate(zip(p.shape, parts[0].shape))):
            raise ShapeError(f"{p.shape} and {parts[0].shape} along axis {axis}")
        moved = _placed(p, {axis: F.col(f"i{axis}") + at}, p.shape).df
        out, at = moved if out is None else out.unionByName(moved), at + p.shape[axis]
    return TensorFrame(out, parts[0].shape[:axis] + (at,) + parts[0].shape[axis + 1 :])


def split(t: TensorFrame, sizes: list[int], axis: int) -> list[TensorFrame]:
    axis, at, out = S.axis_of(axis, t.rank), 0, []
    if sum(sizes) != t.shape[axis]:
        raise ShapeError(f"{sizes} of axis {axis} of {t.shape}")
    for n in sizes:
        out.append(narrow(t, axis, at, n))
        at += n
    return out


def chunk(t: TensorFrame, n: int, axis: int) -> list[TensorFrame]:
    length = t.shape[S.axis_of(axis, t.rank)]
    if n < 1 or length % n:
        raise ShapeError(f"{length} elements in {n} equal parts")
    return split(t, [length // n] * n, axis)


def pad(t: TensorFrame, axis: int, before: int, after: int) -> TensorFrame:
    """Zeros before and after an axis; the gradient of narrow, too."""
    axis = S.axis_of(axis, t.rank)
    spark, parts = t.df.sparkSession, []
    for n in (before, None, after):
        if n is None:
            parts.append(t)
        elif n:
            parts.append(TensorFrame.generated(spark, t.shape[:axis] + (n,) + t.shape[axis + 1 :], lambda *_: F.lit(0.0)))
    return cat(parts, axis)


def patches(images: TensorFrame, size: int) -> TensorFrame:
    """[batch, channel, y, x] as [batch, patch, channel * y * x of the patch], patches row by row."""
    b, c, h, w = images.shape
    if h % size or w % size:
        raise ShapeError(f"patches of {size} from {h} x {w}")
    y, x = F.col("i2"), F.col("i3")
    patch = F.floor(y / size) * (w // size) + F.floor(x / size)
    inner = F.col("i1") * (size * size) + F.pmod(y, F.lit(size)) * size + F.pmod(x, F.lit(size))
    df = images.df.select("i0", patch.cast("bigint").alias("i1"), inner.cast("bigint").alias("i2"), "v")
    return TensorFrame(df, (b, (h // size) * (w // size), c * size * size))
