"""Shapes: broadcasting and checks, on the driver."""

from __future__ import annotations

from math import prod

from .errors import RankError, ShapeError

MAX_RANK = 8
Shape = tuple[int, ...]


def checked(shape: Shape) -> Shape:
    shape = tuple(int(n) for n in shape)
    if len(shape) > MAX_RANK:
        raise RankError(f"rank {len(shape)} is over {MAX_RANK}")
    if any(n < 0 for n in shape):
        raise ShapeError(f"negative length in {shape}")
    return shape


def axis_of(axis: int, rank: int) -> int:
    at = axis + rank if axis < 0 else axis
    if not 0 <= at < rank:
        raise RankError(f"axis {axis} of rank {rank}")
    return at


def broadcast(a: Shape, b: Shape) -> Shape:
    """The common shape: axes align at the end, and lengths are equal or one of them is 1."""
    rank = max(len(a), len(b))
    pairs = zip((1,) * (rank - len(a)) + a, (1,) * (rank - len(b)) + b)
    out = []
    for x, y in pairs:
        if x != y and 1 not in (x, y):
            raise ShapeError(f"{a} and {b} do not broadcast")
        out.append(y if x == 1 else x)
    return checked(tuple(out))


def strides(shape: Shape) -> Shape:
    return tuple(prod(shape[k + 1 :]) for k in range(len(shape)))
