"""Connected components of a large graph, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])
MAX_ROUNDS = 60


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component), without the latter themselves, for the edges a - b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(step := new[new], new):
            new = step
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one task as a forest; every so many edges, what has been gathered is contracted."""
    u, v, held = [], [], 0
    for batch in batches:
        u.append(batch.column("u").to_numpy())
        v.append(batch.column("v").to_numpy())
        held += batch.num_rows
        if held > 1_000_000:
            a, b = forest(np.concatenate(u), np.concatenate(v))
            u, v, held = [a], [b], 0
            if len(a) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_EDGE)
                u, v = [], []
    if u:
        a, b = forest(np.concatenate(u), np.concatenate(v))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_EDGE)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node that each node of edges(u, v) reaches; over a written table.

    Self-loops and repeated edges are allowed and loops alone name no node. Each task first contracts its own
    edges. Then large-star and small-star rounds hang every node's larger, then its smaller neighbours on the
    least of them, until all hang on roots. Both sides of each join are tables, so that Spark splits a hub's rows.
    """
    own = edges.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")).where("u != v")
    now = written(own.mapInArrow(_contract, "u bigint, v bigint").distinct(), name)  # u > v
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u != v").distinct(), name)
        dropped(now)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(hung.union(lowest.select("u", F.col("m").alias("v"))).distinct(), name)
        dropped(large)
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    out._scratch_path = now._scratch_path
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether each node hangs on one other node, which hangs on none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.union(edges.select(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs + holds > 1").isEmpty()
