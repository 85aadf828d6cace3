"""Functions of double columns. Like IEEE arithmetic, they give infinities and NaN where Spark gives nulls or errors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def number(x: float) -> Column:
    return F.lit(float(x))


def fdiv(a: Column, b: Column) -> Column:
    """a / b, with infinities and NaN for divisors of 0 (a negative zero counts as positive)."""
    by_zero = F.when((a == 0) | F.isnan(a), number(math.nan)).when(a > 0, number(INF)).otherwise(number(-INF))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def flog(x: Column) -> Column:
    """Natural logarithm: minus infinity at 0, NaN below."""
    return F.when(x == 0, number(-INF)).when(x < 0, number(math.nan)).otherwise(F.log(x))


def recip(x: Column) -> Column:
    return fdiv(number(1), x)


def rsqrt(x: Column) -> Column:
    return recip(F.sqrt(x))


def sign(x: Column) -> Column:
    """-1, 0 or 1; 0 for NaN."""
    return F.when(F.isnan(x), number(0)).when(x > 0, number(1)).when(x < 0, number(-1)).otherwise(number(0))


def round_half_away(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(F.signum(x) * F.floor(F.abs(x) + 0.5).cast("double"))


def floor(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(F.floor(x).cast("double"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, number(0))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def softplus(x: Column) -> Column:
    return F.greatest(x, number(0)) + F.log1p(F.exp(-F.abs(x)))


def erf(x: Column) -> Column:
    """The error function, to about 1e-13: up to 3 its series of positive terms, above a continued fraction of its complement."""
    twice, series = 2 * x * x, number(1)
    for k in range(55, 0, -1):
        series = 1 + twice / (2 * k + 1) * series
    small = x * F.exp(-x * x) * (2 / math.sqrt(math.pi)) * series
    away = F.greatest(F.abs(x), number(3))
    rest = away
    for k in range(24, 0, -1):
        rest = away + (k / 2) / rest
    large = sign(x) * (1 - F.exp(-away * away) / (math.sqrt(math.pi) * rest))
    return F.when(F.isnan(x), x).when(F.abs(x) <= 3, small).otherwise(large)


def gelu(x: Column) -> Column:
    return x * 0.5 * (1 + erf(x / math.sqrt(2)))


ACTIVATIONS = {"silu": silu, "gelu": gelu, "relu": relu, "tanh": F.tanh, "sigmoid": sigmoid, "identity": lambda x: x}


def gt(x: Column, a: Column) -> Column:
    """1 or 0; comparisons with NaN are 0."""
    return F.when(~F.isnan(x) & ~F.isnan(a) & (x > a), number(1)).otherwise(number(0))


def lt(x: Column, a: Column) -> Column:
    return F.when(~F.isnan(x) & ~F.isnan(a) & (x < a), number(1)).otherwise(number(0))


def eq(x: Column, a: Column) -> Column:
    return F.when(~F.isnan(x) & ~F.isnan(a) & (x == a), number(1)).otherwise(number(0))


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        x = F.greatest(x, number(low))
    return F.least(x, number(high)) if high is not None else x


def wrap_to(x: Column, period: float) -> Column:
    """x less the nearest multiple of the period (halves round away from 0)."""
    return x - round_half_away(x / period) * period


def exp_decay(a: Column, b: Column | None = None, factor: Column | None = None, floor_at: float = -60.0) -> Column:
    """exp of a - b, held between floor_at and 0, times a factor."""
    out = F.exp(clamp(a - b if b is not None else a, floor_at, 0.0))
    return out * factor if factor is not None else out


# The multipliers of the hash below.
HASH_MULTIPLIERS = (0x7FEB352D, 0x846CA68B)


def keep_mask(index: Column, p: float, seed: int) -> Column:
    """The dropout factor of a cell by its linear index: 1 / (1 - p) where it is kept, else 0.

    A 32-bit hash of index and 64-bit seed decides, whatever the partitioning. Products are taken in 16-bit
    halves, for whole ones would overflow 64 bits.
    """
    keep = float(np.float32(1 - p))
    if keep <= 0:
        return number(0)
    low, high = F.lit(seed & 0xFFFFFFFF), F.lit((seed >> 32) & 0xFFFFFFFF)

    def times(h: Column, m: int) -> Column:
        upper = F.shiftleft((F.shiftright(h, 16) * F.lit(m)).bitwiseAND(F.lit(0xFFFF)), 16)
        return (h.bitwiseAND(F.lit(0xFFFF)) * F.lit(m) + upper).bitwiseAND(F.lit(0xFFFFFFFF))

    def folded(h: Column, bits: int) -> Column:
        return h.bitwiseXOR(F.shiftright(h, bits))

    h = index.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(low)
    h = times(folded(h, 16), HASH_MULTIPLIERS[0])
    h = times(folded(h, 15), HASH_MULTIPLIERS[1])
    h = folded(h.bitwiseXOR(high), 16)
    return F.when(F.shiftright(h, 8).cast("double") / float(1 << 24) < keep, number(1 / keep)).otherwise(number(0))


def to_bfloat16(values: np.ndarray) -> np.ndarray:
    """float32 values rounded to bfloat16, ties to even; NaN stays NaN."""
    bits = np.asarray(values, np.float32).view(np.uint32)
    rounded = (bits + 0x7FFF + ((bits >> 16) & 1)) & np.uint32(0xFFFF0000)
    return np.where(np.isnan(values), np.float32(np.nan), rounded.view(np.float32))


def rounded(x: Column, kind: str) -> Column:
    """A double column rounded to float32, float16 or bfloat16 and back."""
    if kind == "float32":
        return x.cast("float").cast("double")

    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        v = values.to_numpy(zero_copy_only=False).astype(np.float32)
        return pa.array((v.astype(np.float16) if kind == "float16" else to_bfloat16(v)).astype(np.float64))

    return run(x)
