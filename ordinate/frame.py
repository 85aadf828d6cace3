"""TensorFrame: a tensor as a relation of axis columns i0, i1, ... and a value column v.

It is dense: every coordinate of its shape is a row, once. Axes of length 1 are kept as columns of zeros.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shape as S
from .errors import ConfigError, ShapeError


def axes(rank: int) -> list[str]:
    return [f"i{k}" for k in range(rank)]


@dataclass(frozen=True)
class TensorFrame:
    df: DataFrame
    shape: S.Shape

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def axes(self) -> list[str]:
        return axes(self.rank)

    @property
    def size(self) -> int:
        return prod(self.shape)

    @staticmethod
    def of(df: DataFrame, keys: list[str], value: str | Column, shape: S.Shape) -> TensorFrame:
        """The rows of df with their key columns as axes."""
        shape = S.checked(shape)
        if len(keys) != len(shape):
            raise ShapeError(f"{len(keys)} keys for the shape {shape}")
        v = F.col(value) if isinstance(value, str) else value
        named = [F.col(k).cast("bigint").alias(a) for k, a in zip(keys, axes(len(keys)))]
        return TensorFrame(df.select(*named, v.cast("double").alias("v")), shape)

    @staticmethod
    def from_rows(df: DataFrame, keys: list[str], array: str, shape: S.Shape) -> TensorFrame:
        """Rows with an array column as its last axis."""
        spread = df.select(*keys, F.posexplode(array).alias("_at", "_v"))
        return TensorFrame.of(spread, [*keys, "_at"], "_v", shape)

    @staticmethod
    def from_data(spark: SparkSession, data: list[float], shape: S.Shape) -> TensorFrame:
        """Row-major data of the driver."""
        shape = S.checked(shape)
        if len(data) != prod(shape):
            raise ShapeError(f"{len(data)} values for the shape {shape}")
        df = spark.createDataFrame([(k, float(x)) for k, x in enumerate(data)], "_at bigint, v double")
        return TensorFrame(df.select(*unravelled(F.col("_at"), shape), "v"), shape)

    @staticmethod
    def generated(spark: SparkSession, shape: S.Shape, value) -> TensorFrame:
        """value: a function from the columns of the coordinates to the value column."""
        shape = S.checked(shape)
        df = spark.range(prod(shape)).select(*unravelled(F.col("id"), shape))
        return TensorFrame(df.withColumn("v", value(*[F.col(a) for a in axes(len(shape))]).cast("double")), shape)

    def to_data(self) -> list[float]:
        """All values in row-major order, on the driver: for small tensors."""
        ordered = self.df.orderBy(*self.axes) if self.rank else self.df
        return [r.v for r in ordered.collect()]

    def to_rows(self, name: str = "x") -> DataFrame:
        """The last axis as an array column in its order."""
        *keys, last = self.axes
        packed = F.transform(F.array_sort(F.collect_list(F.struct(last, "v"))), lambda s: s.v)
        return self.df.groupBy(*keys).agg(packed.alias(name))

    def linear(self) -> Column:
        """The row-major index of a cell."""
        out = F.lit(0).cast("bigint")
        for a, n in zip(self.axes, S.strides(self.shape)):
            out = out + F.col(a) * n
        return out

    def map(self, f) -> TensorFrame:
        return TensorFrame(self.df.withColumn("v", f(F.col("v"))), self.shape)


def unravelled(index: Column, shape: S.Shape) -> list[Column]:
    """The coordinates of a row-major index."""
    return [
        F.pmod(F.floor(index / F.lit(max(1, s))).cast("bigint"), F.lit(max(1, n))).alias(a)
        for a, n, s in zip(axes(len(shape)), shape, S.strides(shape))
    ]


def full(spark: SparkSession, shape: S.Shape, x: float) -> TensorFrame:
    return TensorFrame.generated(spark, shape, lambda *_: F.lit(float(x)))


def zeros(spark: SparkSession, shape: S.Shape) -> TensorFrame:
    return full(spark, shape, 0.0)


def ones(spark: SparkSession, shape: S.Shape) -> TensorFrame:
    return full(spark, shape, 1.0)


def arange(spark: SparkSession, n: int) -> TensorFrame:
    return TensorFrame.generated(spark, (n,), lambda i: i)


def eye(spark: SparkSession, n: int) -> TensorFrame:
    return TensorFrame.generated(spark, (n, n), lambda i, j: (i == j).cast("double"))


def causal_mask(spark: SparkSession, n: int, strict: bool = False) -> TensorFrame:
    """1 where the column is not after (strict: before) the row."""
    return TensorFrame.generated(spark, (n, n), lambda i, j: (j < i if strict else j <= i).cast("double"))


def uniform(spark: SparkSession, shape: S.Shape, low: float, high: float, seed: int) -> TensorFrame:
    """Values from low to high by a hash of the coordinates: the same for any partitioning."""
    def draw(*at: Column) -> Column:
        u = F.pmod(F.xxhash64(*at, F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)
        return low + u * (high - low) if high > low else F.lit(float(low))

    return TensorFrame.generated(spark, shape, draw)


def normal(spark: SparkSession, shape: S.Shape, mean: float, std: float, seed: int) -> TensorFrame:
    """Normal values by the polar form of two hashes; a std of 0 or less gives the mean."""
    def draw(*at: Column) -> Column:
        if std <= 0:
            return F.lit(float(mean))
        u, w = (F.pmod(F.xxhash64(*at, F.lit(2 * seed + k)), F.lit(1 << 53)).cast("double") / float(1 << 53) for k in (0, 1))
        return mean + std * F.sqrt(-2 * F.log(1 - u)) * F.cos(w * 6.283185307179586)

    return TensorFrame.generated(spark, shape, draw)


def initial(spark: SparkSession, shape: S.Shape, kind: str, seed: int = 0, *, value: float = 0.0, gain: float = 1.0, std: float = 0.02, low: float = -1.0, high: float = 1.0, depth: int = 1) -> TensorFrame:
    """Starting values of a parameter. fan-in is the first axis, fan-out the second (or the first)."""
    fan_in, fan_out = (shape[0] if shape else 1), (shape[1] if len(shape) > 1 else shape[0] if shape else 1)
    even = {"uniform": (low, high), "kaiming_uniform": gain * (3 / fan_in) ** 0.5, "xavier_uniform": gain * (6 / (fan_in + fan_out)) ** 0.5}
    spread = {"normal": std, "kaiming_normal": gain / fan_in**0.5, "xavier_normal": gain * (2 / (fan_in + fan_out)) ** 0.5, "residual": std / (2 * depth) ** 0.5}
    if kind in ("zeros", "ones", "constant"):
        return full(spark, shape, {"zeros": 0.0, "ones": 1.0, "constant": value}[kind])
    if kind in even:
        a, b = even[kind] if kind == "uniform" else (-even[kind], even[kind])
        return uniform(spark, shape, a, b, seed)
    if kind not in spread:
        raise ConfigError(f"no initial values {kind}")
    return normal(spark, shape, value, spread[kind], seed)
