"""Matrices in tiles, and their products.

A tile is a row: its place, and side * side doubles at most, row after row. A product joins the tiles of both sides that share a place on the contracted
axis, multiplies each pair in an Arrow batch, adds what lands on the same tile within a task, and sums these by tile: nothing has a row for each
product of two cells. Where the contracted axis is the long one, tasks send on little more than the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import shape as S
from ..errors import ConfigError, ShapeError
from ..frame import TensorFrame

#: Side of a tile (512 KB), and bytes of products that a task holds before it sends them on.
SIDE, HELD_BYTES = 256, 64 << 20


def _cells(places: pa.Array, values: pa.Array, sizes: pa.Array) -> pa.Array:
    """The tiles of lists of (place, values): each must have all its size cells, once."""
    out = []
    for at, v, size in zip(places, values, sizes.to_pylist()):
        order = np.argsort(at.values.to_numpy(), kind="stable")
        flat = v.values
        own = flat.to_numpy(zero_copy_only=False) if not pa.types.is_list(flat.type) else np.array(flat.flatten().to_numpy(zero_copy_only=False)).reshape(len(flat), -1)
        own = np.ascontiguousarray(own[order], np.float64)
        if own.size != size:
            raise ValueError(f"a tile of {size} cells has {own.size}")
        out.append(own.tobytes())
    return pa.array(out, pa.binary())


def _gathered(df: DataFrame, lead: list[str], size) -> DataFrame:
    """(lead, r, c, data) of rows (lead, r, c, p, v): v are cells or stretches of a tile, p their order."""
    lists = df.groupBy(*lead, "r", "c").agg(F.collect_list("p").alias("p"), F.collect_list("v").alias("v"))  # a tile at most
    return lists.select(*lead, "r", "c", F.arrow_udf(_cells, "binary")("p", "v", size).alias("data"))


@dataclass(frozen=True)
class Tiles:
    """Matrices of the last two axes of shape, one for each place on the axes before, as (i0, ..., r, c, data)."""

    df: DataFrame
    shape: S.Shape
    side: int = SIDE

    def __post_init__(self) -> None:
        if len(self.shape) < 2 or self.side < 1:
            raise ShapeError(f"tiles of {self.side} for {self.shape}")

    @property
    def lead(self) -> list[str]:
        return [f"i{k}" for k in range(len(self.shape) - 2)]

    @staticmethod
    def of(t: TensorFrame, side: int = SIDE) -> Tiles:
        """The tiles of a tensor relation."""
        made = Tiles(t.df, t.shape, side)
        i, j = (F.col(a) for a in t.axes[-2:])
        rows = t.df.select(*made.lead, F.floor(i / side).alias("r"), F.floor(j / side).alias("c"), ((i % side) * side + j % side).alias("p"), "v")
        return Tiles(_gathered(rows, made.lead, made._size()), t.shape, side)

    @staticmethod
    def of_rows(df: DataFrame, index: str, array: str, shape: S.Shape, side: int = SIDE) -> Tiles:
        """The tiles of rows numbered by index, whose cells are an array: these are cut, not spread to cells."""
        made = Tiles(df, S.checked(shape), side)
        starts = F.sequence(F.lit(0).cast("bigint"), F.lit((shape[1] - 1) // side).cast("bigint"))
        cut = df.select(F.floor(F.col(index) / side).alias("r"), (F.col(index) % side).alias("p"), F.explode(starts).alias("c"), F.col(array).cast("array<double>").alias("_x"))
        cut = cut.select("r", "c", "p", F.slice("_x", (F.col("c") * side + 1).cast("int"), side).alias("v"))
        return Tiles(_gathered(cut, [], made._size()), made.shape, side)

    def _size(self):
        m, n = self.shape[-2:]
        return F.least(F.lit(self.side), F.lit(m) - F.col("r") * self.side) * F.least(F.lit(self.side), F.lit(n) - F.col("c") * self.side)

    def frame(self) -> TensorFrame:
        """The tensor relation of all cells."""
        side, width, lead = self.side, self.shape[-1], self.lead

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    r, c = (batch.column(x)[k].as_py() for x in "rc")
                    cells = np.frombuffer(batch.column("data")[k].as_buffer(), np.float64).reshape(-1, min(side, width - c * side))
                    i, j = np.indices(cells.shape)
                    names = [batch.column(x)[k].as_py() for x in lead]
                    arrays = [pa.array(np.full(cells.size, v)) for v in names] + [pa.array((i + r * side).ravel()), pa.array((j + c * side).ravel()), pa.array(cells.ravel())]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*lead, f"i{len(lead)}", f"i{len(lead) + 1}", "v"])

        kind = ", ".join([f"i{k} bigint" for k in range(len(self.shape))] + ["v double"])
        return TensorFrame(self.df.select(*lead, "r", "c", "data").mapInArrow(run, kind), self.shape)


def _products(lead: list[str], widths: tuple[int, int], side: int, transposed: tuple[bool, bool]):
    """(lead, i, j, data) of pairs of tiles, those of one tile of the result added up as long as they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        size = 0

        def sent() -> pa.RecordBatch:
            nonlocal size
            keys = list(held)
            arrays = [pa.array([k[x] for k in keys], pa.int64()) for x in range(len(lead) + 2)] + [pa.array([v.tobytes() for v in held.values()], pa.binary())]
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays(arrays, names=[*lead, "i", "j", "data"])

        for batch in batches:
            for k in range(batch.num_rows):
                sides = []
                for name, place, width, turned in zip("ab", ("ca", "cb"), widths, transposed):
                    cells = np.frombuffer(batch.column(name)[k].as_buffer(), np.float64).reshape(-1, min(side, width - batch.column(place)[k].as_py() * side))
                    sides.append(cells.T if turned else cells)
                key = tuple(batch.column(c)[k].as_py() for c in (*lead, "i", "j"))
                product = sides[0] @ sides[1]
                if key in held:
                    held[key] += product
                else:
                    held[key] = product
                    size += product.nbytes
                if size >= HELD_BYTES:
                    yield sent()
        if held:
            yield sent()

    return run


def _sums(lead: list[str]):
    """Rows come sorted by tile: those of one are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def ended() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in at] + [pa.array([total.tobytes()], pa.binary())], names=[*lead, "r", "c", "data"])

        for batch in batches:
            for k in range(batch.num_rows):
                key = tuple(batch.column(c)[k].as_py() for c in (*lead, "i", "j"))
                own = np.frombuffer(batch.column("data")[k].as_buffer(), np.float64)
                if key == at:
                    total = total + own
                else:
                    if at is not None:
                        yield ended()
                    at, total = key, own
        if at is not None:
            yield ended()

    return run


def matmul(a: Tiles, b: Tiles, transpose_a: bool = False, transpose_b: bool = False) -> Tiles:
    """The product of the last two axes; the axes before are the same on both sides."""
    if a.side != b.side:
        raise ConfigError(f"tiles of {a.side} and of {b.side}")
    m, ka = (a.shape[-1], a.shape[-2]) if transpose_a else a.shape[-2:]
    kb, n = (b.shape[-1], b.shape[-2]) if transpose_b else b.shape[-2:]
    if ka != kb or a.shape[:-2] != b.shape[:-2]:
        raise ShapeError(f"{a.shape} @ {b.shape}")
    lead = a.lead
    own, shared = ("c", "r") if transpose_a else ("r", "c")
    left = a.df.select(*lead, F.col(own).alias("i"), F.col(shared).alias("k"), F.col("c").alias("ca"), F.col("data").alias("a"))
    own, shared = ("r", "c") if transpose_b else ("c", "r")
    right = b.df.select(*[F.col(x).alias(f"_{x}") for x in lead], F.col(own).alias("j"), F.col(shared).alias("_k"), F.col("c").alias("cb"), F.col("data").alias("b"))
    on = [F.col("k") == F.col("_k")] + [F.col(x) == F.col(f"_{x}") for x in lead]
    pairs = left.join(right, on).select(*lead, "i", "j", "ca", "cb", "a", "b")
    kind = T.StructType([T.StructField(x, T.LongType()) for x in [*lead, "i", "j"]] + [T.StructField("data", T.BinaryType())])
    parts = pairs.mapInArrow(_products(lead, (a.shape[-1], b.shape[-1]), a.side, (transpose_a, transpose_b)), kind)
    dealt = parts.repartition(*lead, "i", "j").sortWithinPartitions(*lead, "i", "j")
    out = T.StructType([T.StructField(x, T.LongType()) for x in [*lead, "r", "c"]] + [T.StructField("data", T.BinaryType())])
    return Tiles(dealt.mapInArrow(_sums(lead), out), (*a.shape[:-2], m, n), a.side)


def weight_gradient(x: TensorFrame, g: TensorFrame, side: int = SIDE) -> TensorFrame:
    """The sum over all leading axes of xᵀ g."""
    if x.shape[:-1] != g.shape[:-1]:
        raise ShapeError(f"{x.shape} and {g.shape}")

    def flat(t: TensorFrame) -> Tiles:
        rows = F.lit(0).cast("bigint")
        for axis, n in zip(t.axes[:-1], t.shape[:-1]):
            rows = rows * n + F.col(axis)
        count = int(np.prod(t.shape[:-1]))
        return Tiles.of(TensorFrame(t.df.select(rows.alias("i0"), F.col(t.axes[-1]).alias("i1"), "v"), (count, t.shape[-1])), side)

    return matmul(flat(x), flat(g), transpose_a=True).frame()
