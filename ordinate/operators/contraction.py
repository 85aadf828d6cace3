"""Contractions: an equi-join on the shared axes and a grouped sum."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import shape as S
from ..errors import ConfigError, ShapeError
from ..frame import TensorFrame
from ..functions.scalar import rounded
from . import tiles
from .elemwise import BROADCAST_CELLS

PRECISIONS = ("float64", "float32", "float16", "bfloat16")
STRATEGIES = ("auto", "broadcast", "shuffle", "rows", "tiles")


def matmul(a: TensorFrame, b: TensorFrame, transpose_a: bool = False, transpose_b: bool = False, precision: str = "float64", strategy: str = "auto") -> TensorFrame:
    """The product of the last two axes, leading axes broadcast.

    precision rounds the operands before they are multiplied; sums are in double. strategy is how the join is done,
    never what comes out: rows packs the left side's rows and the whole right side into arrays and needs no
    shuffle of products, for a right side of two axes that is small; tiles, for equal leading axes, multiplies matrices by tiles, where the
    others have a row for each product. auto takes tiles where neither side is small.
    """
    if a.rank < 2 or b.rank < 2:
        raise ShapeError("a matrix product needs two axes on each side")
    if precision not in PRECISIONS or strategy not in STRATEGIES:
        raise ConfigError(f"{precision}, {strategy}")
    ma, ka = (-1, -2) if transpose_a else (-2, -1)
    kb, nb = (-1, -2) if transpose_b else (-2, -1)
    if a.shape[ka] != b.shape[kb]:
        raise ShapeError(f"{a.shape} @ {b.shape}")
    lead = S.broadcast(a.shape[:-2], b.shape[:-2])
    if precision != "float64":
        a, b = a.map(lambda v: rounded(v, precision)), b.map(lambda v: rounded(v, precision))
    axis = lambda t, k: F.col(f"i{t.rank + k}")
    if strategy == "rows" or strategy == "auto" and b.rank == 2 and b.size <= 16_384 and a.rank == 2 and not transpose_a:
        return _by_rows(a, b, kb, nb)
    if strategy == "tiles" or strategy == "auto" and a.shape[:-2] == b.shape[:-2] and min(a.size, b.size) > BROADCAST_CELLS:
        return tiles.matmul(tiles.Tiles.of(a), tiles.Tiles.of(b), transpose_a, transpose_b).frame()

    def side(t: TensorFrame, own: int, shared: int, prefix: str):
        columns, names = [axis(t, own).alias(f"{prefix}own"), axis(t, shared).alias(f"{prefix}k"), F.col("v").alias(f"{prefix}v")], []
        before = len(lead) - (t.rank - 2)
        for k, n in enumerate(t.shape[:-2]):
            if n == lead[before + k]:
                columns.append(F.col(f"i{k}").alias(f"{prefix}{before + k}"))
                names.append(before + k)
        return t.df.select(*columns), names

    left, la = side(a, ma, ka, "l_")
    right, lb = side(b, nb, kb, "r_")
    if strategy == "broadcast" or strategy == "auto" and min(a.size, b.size) <= BROADCAST_CELLS:
        left, right = (F.broadcast(left), right) if a.size < b.size else (left, F.broadcast(right))
    on = [F.col("l_k") == F.col("r_k")] + [F.col(f"l_{k}") == F.col(f"r_{k}") for k in la if k in lb]
    keys = [F.col(f"l_{k}" if k in la else f"r_{k}").alias(f"i{k}") for k in range(len(lead))]
    keys += [F.col("l_own").alias(f"i{len(lead)}"), F.col("r_own").alias(f"i{len(lead) + 1}")]
    df = left.join(right, on).groupBy(*keys).agg(F.sum(F.col("l_v") * F.col("r_v")).alias("v"))
    return TensorFrame(df, lead + (a.shape[ma], b.shape[nb]))


def _by_rows(a: TensorFrame, b: TensorFrame, kb: int, nb: int) -> TensorFrame:
    """Each row of a against each column of b, both as arrays: products are summed within a row."""
    if a.rank != 2 or b.rank != 2:
        raise ShapeError("the strategy rows needs two axes on each side")
    rows = a.to_rows("_a")
    columns = b.df.groupBy(F.col(f"i{2 + nb}").alias("_n")).agg(F.transform(F.array_sort(F.collect_list(F.struct(f"i{2 + kb}", "v"))), lambda s: s.v).alias("_b"))
    both = rows.crossJoin(F.broadcast(columns))  # b is small: this makes the rows of the result
    dot = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return TensorFrame(both.select("i0", F.col("_n").alias("i1"), dot.alias("v")), (a.shape[0], b.shape[nb]))


def matmul_nt(a: TensorFrame, b: TensorFrame, **how) -> TensorFrame:
    return matmul(a, b, transpose_b=True, **how)


def matmul_tn(a: TensorFrame, b: TensorFrame, **how) -> TensorFrame:
    return matmul(a, b, transpose_a=True, **how)


def weight_gradient(x: TensorFrame, g: TensorFrame) -> TensorFrame:
    """The sum over all leading axes of xᵀ g: they are contracted with the rows, by tiles."""
    return tiles.weight_gradient(x, g)
