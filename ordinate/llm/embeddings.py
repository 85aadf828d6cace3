"""Embedding near-dedup by an epsilon grid order join.

Vectors are scaled to length 1, so that a cosine of COSINE or more is a Euclidean distance of EPSILON at most, and
projected on the corpus's leading principal axes. The projections are cut into grid cells of EPSILON; sorted by
label and cells, neighbours in space are neighbours in sequence. The sequence is cut into blocks, and runs of
blocks into intervals. Pairs of intervals, then of blocks, then of halves of blocks within a task are joined, as
far as their bounding boxes are not provably further apart than EPSILON. Cosines are taken of the whole vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, prepare, small, written
from .graph import components, forest

COSINE = 0.98
EPSILON = math.sqrt(2 - 2 * COSINE)
#: Principal axes in the grid; vectors of a block, blocks of an interval, vectors of a leaf of the recursion.
AXES, BLOCK, RUN, LEAF = 6, 512, 32, 64
#: Rounding of distances: boxes must be so much further apart to be skipped.
SLACK = 1e-9


def _valid(vector: Column, label: Column) -> Column:
    """Whether a vector can link: it has a label, and its components are finite, not null and not all zero."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & usable & F.exists(vector, lambda x: x != 0), F.lit(False))


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """The leading principal axes (a row each) of the unit vectors of length dim: sums over all rows, dim by dim + 1 numbers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim + 1, dim)), 0
        for batch in batches:
            x = _matrix(batch.column("vector"), dim)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            total[:dim] += x.T @ x
            total[dim] += x.sum(0)
            n += len(x)
        yield pa.RecordBatch.from_pydict({"i": list(range(dim + 1)), "n": [n] * (dim + 1), "row": list(total)}, schema=kind)

    kind = pa.schema([("i", pa.int64()), ("n", pa.int64()), ("row", pa.list_(pa.float64()))])
    rows = vectors.where(F.col("dim") == dim).select("vector").mapInArrow(sums, "i bigint, n bigint, row array<double>")
    got = rows.groupBy("i").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("row")[j]) for j in range(dim)]).alias("row")).orderBy("i").collect()
    if not got or not got[0].n:
        return np.eye(min(AXES, dim), dim)
    n, mean = got[0].n, np.array(got[dim].row) / got[0].n
    _, axes = np.linalg.eigh(np.array([r.row for r in got[:dim]]) / n - np.outer(mean, mean))
    return axes[:, ::-1].T[:AXES]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in grid order: blocks of BLOCK neighbours of one label and length, with their bounding boxes."""
    part, count = TaskContext.get().partitionId(), 0
    held: list[dict] = []

    def cut() -> pa.RecordBatch:
        nonlocal count, held
        p = np.array([r["at"] for r in held])
        row = {
            "block": part << 28 | count,
            "run": part << 28 | count // RUN,
            "label": held[0]["label"],
            "dim": held[0]["dim"],
            **{f"lo{k}": float(p[:, k].min()) for k in range(AXES)},
            **{f"hi{k}": float(p[:, k].max()) for k in range(AXES)},
            "nodes": np.array([r["node"] for r in held], "<i8").tobytes(),
            "copies": np.array([r["copies"] for r in held], "<i8").tobytes(),
            "points": p.astype("<f8").tobytes(),
            "vectors": np.array([r["vector"] for r in held], "<f8").tobytes(),
        }
        count, held = count + 1, []
        return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

    for batch in batches:
        for r in batch.to_pylist():
            if held and (len(held) == BLOCK or (r["label"], r["dim"]) != (held[0]["label"], held[0]["dim"])):
                yield cut()
            held.append(r)
    if held:
        yield cut()


_BLOCK = pa.schema(
    [("block", pa.int64()), ("run", pa.int64()), ("label", pa.string()), ("dim", pa.int32())]
    + [(f"{side}{k}", pa.float64()) for side in ("lo", "hi") for k in range(AXES)]
    + [(c, pa.binary()) for c in ("nodes", "copies", "points", "vectors")]
)
_BLOCK_SQL = (
    "block bigint, run bigint, label string, dim int, "
    + ", ".join(f"{side}{k} double" for side in ("lo", "hi") for k in range(AXES))
    + ", nodes binary, copies binary, points binary, vectors binary"
)


def _near(a: str, b: str) -> Column:
    """Whether the boxes of two aliased tables are EPSILON apart at most."""
    gaps = [F.greatest(F.col(f"{a}.lo{k}") - F.col(f"{b}.hi{k}"), F.col(f"{b}.lo{k}") - F.col(f"{a}.hi{k}"), F.lit(0.0)) for k in range(AXES)]
    return reduce(lambda x, y: x + y, [g * g for g in gaps]) <= EPSILON**2 + SLACK


def _pairs(boxes: DataFrame) -> DataFrame:
    """(a, b) of blocks, a <= b, that may hold links: first by runs, then by blocks of the runs that remain."""
    ends = [F.min(f"lo{k}").alias(f"lo{k}") for k in range(AXES)] + [F.max(f"hi{k}").alias(f"hi{k}") for k in range(AXES)]
    runs = written(boxes.groupBy("run", "label", "dim").agg(*ends), "runs")
    same = (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim"))
    met = runs.alias("a").join(runs.alias("b"), same & (F.col("a.run") <= F.col("b.run")) & _near("a", "b"))
    met = written(met.select(F.col("a.run").alias("run_a"), F.col("b.run").alias("run_b"), F.col("a.label").alias("of"), F.col("a.dim").alias("wide")), "runs")
    first = met.join(boxes.alias("a"), (F.col("run_a") == F.col("a.run")) & (F.col("of") == F.col("a.label")) & (F.col("wide") == F.col("a.dim")))
    both = first.join(boxes.alias("b"), (F.col("run_b") == F.col("b.run")) & same & (F.col("a.block") <= F.col("b.block")) & _near("a", "b"))
    return both.select(F.col("a.block").alias("a"), F.col("b.block").alias("b"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks: (u, null, n) for n vectors that link with u, and a forest of the links as (u, v, null)."""
    for batch in batches:
        for r in batch.to_pylist():
            side = []
            for s in "ab":
                nodes = np.frombuffer(r[f"nodes_{s}"], "<i8")
                vectors = np.frombuffer(r[f"vectors_{s}"], "<f8").reshape(len(nodes), -1)
                side.append((nodes, np.frombuffer(r[f"copies_{s}"], "<i8"), np.frombuffer(r[f"points_{s}"], "<f8").reshape(len(nodes), -1), vectors, np.linalg.norm(vectors, axis=1)))
            (na, ca, pa_, va, la), (nb, cb, pb, vb, lb) = side
            same = r["a"] == r["b"]
            da, db = np.zeros(len(na), np.int64), np.zeros(len(nb), np.int64)
            us, vs = [], []

            def join(i: int, j: int, k: int, m: int) -> None:
                """Rows i to j of a with k to m of b; on the diagonal, only what lies above it."""
                gap = np.maximum(np.maximum(pa_[i:j].min(0) - pb[k:m].max(0), pb[k:m].min(0) - pa_[i:j].max(0)), 0)
                if gap @ gap > EPSILON**2 + SLACK:
                    return
                if max(j - i, m - k) > LEAF:
                    x, y = (i + j) // 2, (k + m) // 2
                    for p, q in ((i, x), (x, j)):
                        for s, t in ((k, y), (y, m)):
                            if p < q and s < t and not (same and t <= p):
                                join(p, q, s, t)
                    return
                hit = va[i:j] @ vb[k:m].T >= COSINE * la[i:j, None] * lb[None, k:m]
                if same:
                    hit &= np.arange(i, j)[:, None] < np.arange(k, m)[None, :]
                x, y = np.nonzero(hit)
                np.add.at(da, x + i, cb[y + k])
                np.add.at(db, y + k, ca[x + i])
                us.append(na[x + i])
                vs.append(nb[y + k])

            if len(na) and len(nb):
                join(0, len(na), 0, len(nb))
            u, v = forest(np.concatenate(us), np.concatenate(vs)) if us else (na[:0], na[:0])
            node, n = np.concatenate([na, nb]), np.concatenate([da, db])
            node, n = node[n > 0], n[n > 0]
            every = np.arange(len(u) + len(node))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([u, node]), pa.int64()),
                    pa.array(np.concatenate([v, node]), pa.int64(), mask=every >= len(u)),
                    pa.array(np.concatenate([u, n]), pa.int64(), mask=every < len(u)),
                ],
                names=["u", "v", "n"],
            )


def near_duplicates(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    n_links: other rows linked directly, equal vectors included; component_id: the smallest vec_id reachable by
    links, itself included; kept: vec_id is component_id. Vectors that are null, empty, zero or hold null or
    non-finite components, or have no label, link with nothing, as do vectors of different lengths. Equal vectors
    of a label are joined as one. Rows without vec_id link as others, but never name a component that has ids; kept
    is false for them. An empty table gives an empty table.
    """
    prepare(table.sparkSession)
    rows = table.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).cast("string").alias("label"))
    node = F.when(_valid(F.col("vector"), F.col("label")), F.xxhash64("label", "vector"))
    rows = written(rows.withColumn("node", node).withColumn("dim", F.size("vector")), "vectors")
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vector").alias("vector")
    )
    classes = written(classes, "classes")
    usual = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = usual[0].dim if usual else 1
    axes = principal_axes(classes, dim)
    sent = table.sparkSession.sparkContext.broadcast(axes)

    @F.arrow_udf("array<double>")
    def projected(vectors: pa.Array) -> pa.Array:
        out = np.zeros((len(vectors), AXES))
        for k, v in enumerate(vectors.to_pylist()):
            x = np.array(v) / np.linalg.norm(v)
            p = sent.value @ x if len(x) == sent.value.shape[1] else x[:AXES]  # any orthonormal axes bound distances
            out[k, : len(p)] = p
        return pa.array(list(out), pa.list_(pa.float64()))

    cells = [F.floor(F.col("at")[k] / EPSILON).alias(f"cell{k}") for k in range(AXES)]
    placed = written(classes.select("node", "copies", "label", "dim", "vector", projected("vector").alias("at")), "placed").select("*", *cells)
    order = ["label", "dim", *[f"cell{k}" for k in range(AXES)], "node"]
    parts = max(1, min(placed.sparkSession.sparkContext.defaultParallelism * 4, classes.count() // BLOCK))
    parts = max(parts, math.ceil(classes.count() / (BLOCK * RUN * 8)))
    blocks = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("node", "copies", "label", "dim", "vector", "at")
    blocks = written(blocks.mapInArrow(_blocks, _BLOCK_SQL), "blocks")

    pairs = written(_pairs(blocks.drop("nodes", "copies", "points", "vectors")), "pairs")
    data = ["nodes", "copies", "points", "vectors"]
    a = blocks.select(F.col("block").alias("a"), *[F.col(c).alias(f"{c}_a") for c in data])
    b = blocks.select(F.col("block").alias("b"), *[F.col(c).alias(f"{c}_b") for c in data])
    found = pairs.join(a, "a").join(b, "b").mapInArrow(_joined, "u bigint, v bigint, n bigint")
    found = written(found, "links")
    linked = components(found.where("v IS NOT NULL").select("u", "v"), "linked")
    degrees = found.where("n IS NOT NULL").groupBy(F.col("u").alias("node_d")).agg(F.sum("n").alias("n"))

    inside = classes.select("node", "least").join(linked.withColumnRenamed("node", "node_c"), F.col("node") == F.col("node_c"))
    inside = written(inside.select("node", "component", "least"), "inside")
    lowest = written(inside.groupBy("component").agg(F.min("least").alias("lowest")), "lowest")
    of = written(inside.join(lowest, "component").select(F.col("node").alias("node_l"), "lowest"), "of")
    named = classes.join(written(degrees, "degrees"), F.col("node") == F.col("node_d"), "left").join(of, F.col("node") == F.col("node_l"), "left")
    named = named.select("node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("lowest", "least").alias("component_id"))
    named = written(named, "named")
    dropped(placed, blocks, pairs, found, linked, inside, lowest, of)
    out = rows.select("vec_id", F.col("node").alias("node_r")).join(small(named), F.col("node_r") == F.col("node"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
