"""Functions of array<double> columns: a row of a tensor is an array, and work along it needs no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError
from .scalar import fdiv, number, round_half_away, rsqrt


def let(value: Column, f) -> Column:
    """f of a value that is computed once a row: what a lambda refers to is else computed for each element."""
    return F.transform(F.array(value), f)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, number(0), lambda s, v: s + v)


def product(x: Column) -> Column:
    return F.aggregate(x, number(1), lambda s, v: s * v)


def mean(x: Column) -> Column:
    return total(x) / F.greatest(F.size(x), F.lit(1))


def highest(x: Column) -> Column:
    """The maximum; minus infinity of an empty array."""
    return F.coalesce(F.array_max(x), number(float("-inf")))


def lowest(x: Column) -> Column:
    return F.coalesce(F.array_min(x), number(float("inf")))


def argmax(x: Column) -> Column:
    """The first index of the maximum; a NaN counts only in the first place, where it wins."""
    rest = F.array_max(F.filter(x, lambda v: ~F.isnan(v)))
    return F.when(F.isnan(F.get(x, F.lit(0))), F.lit(0)).otherwise(F.array_position(x, rest) - 1).cast("bigint")


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def scaled(x: Column, by: Column) -> Column:
    return F.transform(x, lambda v: v * by)


def plus(*xs: Column) -> Column:
    return reduce(lambda a, b: F.zip_with(a, b, lambda u, v: u + v), xs)


def softmax(x: Column) -> Column:
    e = let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return let(e, lambda p: let(1 / total(p), lambda by: scaled(p, by)))


def log_sum_exp(x: Column) -> Column:
    return let(F.array_max(x), lambda top: top + F.log(total(F.transform(x, lambda v: F.exp(v - top)))))


def log_softmax(x: Column) -> Column:
    return let(log_sum_exp(x), lambda lse: F.transform(x, lambda v: v - lse))


def _rms(x: Column, eps: float) -> Column:
    return rsqrt(total(F.transform(x, lambda v: v * v)) / F.size(x) + eps)


def rms_norm(x: Column, gain: Column | None = None, eps: float = 1e-5) -> Column:
    y = let(_rms(x, eps), lambda r: scaled(x, r))
    return F.zip_with(y, gain, lambda a, b: a * b) if gain is not None else y


def rms_norm_backward(x: Column, g: Column, gain: Column, eps: float = 1e-5) -> tuple[Column, Column]:
    """(gradient of x, this row's part of the gradient of the gain) for the gradient g of the output."""
    weighted = F.zip_with(g, gain, lambda a, b: a * b)
    scales = let(_rms(x, eps), lambda r: F.struct(r.alias("r"), (dot(weighted, x) * r * r * r / F.size(x)).alias("mix")))
    dx = let(scales, lambda s: F.zip_with(weighted, x, lambda a, v: a * s["r"] - v * s["mix"]))
    return dx, let(_rms(x, eps), lambda r: F.zip_with(g, x, lambda a, v: a * v * r))


def layer_norm(x: Column, gain: Column | None = None, bias: Column | None = None, eps: float = 1e-5) -> Column:
    centred = let(mean(x), lambda m: F.transform(x, lambda v: v - m))
    y = let(centred, lambda c: let(_rms(c, eps), lambda r: scaled(c, r)))
    y = F.zip_with(y, gain, lambda a, b: a * b) if gain is not None else y
    return plus(y, bias) if bias is not None else y


def flip(x: Column) -> Column:
    return F.reverse(x)


def part(x: Column, start: int, length: int) -> Column:
    return F.slice(x, start + 1, length)


def one_hot(index: Column, classes: int) -> Column:
    """All zeros for indices outside the classes."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == index, number(1)).otherwise(number(0)))


def take(x: Column, index: Column) -> Column:
    """The element at an index from 0; null outside."""
    return F.get(x, index.cast("int"))


def rotate_halves(x: Column, cos: Column, sin: Column) -> Column:
    """Plane k of the halves (x_k, x_k+n/2) turned by the angle of the arrays cos and sin; lengths must be even."""
    half = (F.size(x) / 2).cast("int")
    first, second = F.slice(x, F.lit(1), half), F.slice(x, half + 1, half)
    turn = F.arrays_zip(first.alias("a"), second.alias("b"), cos.alias("c"), sin.alias("s"))
    return F.concat(F.transform(turn, lambda t: t.a * t.c - t.b * t.s), F.transform(turn, lambda t: t.a * t.s + t.b * t.c))


def rotary(x: Column, position: Column, dim: int, base: float = 10000.0) -> Column:
    """Rotary embedding of an array of dim values at a position."""
    if dim % 2:
        raise ConfigError(f"rotary embedding of an odd dimension {dim}")
    angles = F.array(*[position * float(base ** (-2.0 * k / dim)) for k in range(dim // 2)])
    return rotate_halves(x, F.transform(angles, F.cos), F.transform(angles, F.sin))


def cross_entropy(logits: Column, target: Column, smoothing: float = 0.0) -> Column:
    """Negative log-likelihood of the target class of a row, with label smoothing."""
    return log_sum_exp(logits) - (1 - smoothing) * take(logits, target) - smoothing * mean(logits)


def cross_entropy_gradient(logits: Column, target: Column, smoothing: float = 0.0) -> Column:
    hot = lambda i: F.when(i == target, number(1 - smoothing)).otherwise(number(0))
    return F.transform(softmax(logits), lambda p, i: p - hot(i) - smoothing / F.size(logits))


def quantizer(low: Column, high: Column, bits: int = 8, symmetric: bool = True) -> tuple[Column, Column, int, int]:
    """(scale, zero point, least, greatest level) for values between low and high."""
    if not 2 <= bits <= 16:
        raise ConfigError(f"{bits} bits; 2 to 16 are possible")
    if symmetric:
        top = 2 ** (bits - 1) - 1
        return F.greatest(F.abs(low), F.abs(high), number(1e-12)) / float(top), number(0), -top, top
    top = 2**bits - 1
    low, high = F.least(low, number(0)), F.greatest(high, number(0))
    scale = F.greatest(high - low, number(1e-12)) / float(top)
    return scale, round_half_away(-fdiv(low, scale)), 0, top


def quantized(x: Column, scale: Column, zero: Column, least: int, greatest: int) -> Column:
    """A value at the nearest level, rounded before it is held to the levels, and back."""
    level = F.least(F.greatest(round_half_away(x / scale + zero), number(least)), number(greatest))
    return (level - zero) * scale
