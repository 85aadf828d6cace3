"""Attention over keyed sequences by tiles: chunks of queries against chunks of keys.

A sequence of n rows has n / chunk chunks of either kind, so that the pairs of chunks that are joined are fewer than the pairs of rows by the square of
the chunk's length. Each pair gives a partial softmax of its queries: the greatest score, the sum of the weights, and the sum of the weighted
values. Partial ones merge in any order, first within a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError

#: Rows of a chunk; chunks that a task puts in a batch of its results.
CHUNK, TOGETHER = 64, 128


class Partial:
    """The softmax of [rows, heads] queries over some of the keys: what is the greatest score, and sums relative to it."""

    def __init__(self, top: np.ndarray, total: np.ndarray, sums: np.ndarray) -> None:
        self.top, self.total, self.sums = top, total, sums

    @staticmethod
    def of(q: np.ndarray, k: np.ndarray, v: np.ndarray, seen: np.ndarray | None, scale: float, heads: int, groups: int) -> Partial:
        """q [n, heads * wide], k [m, groups * wide], v [m, groups * deep]; seen [n, m] says which keys a query has (null: all)."""
        n, m = len(q), len(k)
        q, k, v = q.reshape(n, groups, heads // groups, -1), k.reshape(m, groups, -1), v.reshape(m, groups, -1)
        score = np.einsum("nghw,mgw->nghm", q, k) * scale
        if seen is not None:
            score = np.where(seen[:, None, None, :], score, -np.inf)
        top = score.max(-1, initial=-np.inf)
        weight = np.exp(score - np.where(np.isfinite(top), top, 0.0)[..., None])
        sums = np.einsum("nghm,mgd->nghd", weight, v)
        return Partial(top.reshape(n, heads), weight.sum(-1).reshape(n, heads), sums.reshape(n, heads, -1))

    def merged(self, other: Partial) -> Partial:
        top = np.maximum(self.top, other.top)
        safe = np.where(np.isfinite(top), top, 0.0)
        mine, theirs = np.exp(self.top - safe), np.exp(other.top - safe)
        return Partial(top, self.total * mine + other.total * theirs, self.sums * mine[..., None] + other.sums * theirs[..., None])

    def out(self) -> np.ndarray:
        """[n, heads * deep]."""
        return (self.sums / self.total[..., None]).reshape(len(self.top), -1)


def _matrix(lists: pa.Array, rows: int) -> np.ndarray:
    return np.array(lists.flatten().to_numpy(zero_copy_only=False), float).reshape(rows, -1)


def _partials(keys: list[str], scale: float, heads: int, groups: int, causal: bool):
    """Of each pair of chunks; those of one chunk of queries that follow one another are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, times, held, done = None, None, None, []
        for batch in batches:
            names = batch.select([*keys, "i"]).to_pylist()
            for row, name in enumerate(names):
                a, b = batch.column("queries")[row].values, batch.column("seen")[row].values
                tq, tk = a.field("t").to_numpy(), b.field("t").to_numpy()
                mask = tk[None, :] <= tq[:, None] if causal else None
                own = Partial.of(_matrix(a.field("q"), len(a)), _matrix(b.field("k"), len(b)), _matrix(b.field("v"), len(b)), mask, scale, heads, groups)
                if name != at:
                    if held is not None:
                        done.append((at, times, held))
                    if len(done) >= TOGETHER:
                        yield _packed(keys, done)
                        done = []
                    at, times, held = name, tq, own
                else:  # the same chunk has its rows in the same order
                    held = held.merged(own)
        if held is not None:
            yield _packed(keys, [*done, (at, times, held)])

    return run


def _packed(keys: list[str], done: list[tuple[dict, np.ndarray, Partial]]) -> pa.RecordBatch:
    found = (([t for _, t, _ in done], pa.int64()), *(([getattr(p, c).ravel() for _, _, p in done], pa.float64()) for c in ("top", "total", "sums")))
    lists = [pa.array(x, pa.list_(kind)) for x, kind in found]
    return pa.RecordBatch.from_arrays([pa.array([at[k] for at, _, _ in done]) for k in (*keys, "i")] + lists, names=[*keys, "i", "t", "top", "total", "sums"])


def _merge(keys: list[str], heads: int):
    """Rows come sorted by (keys, i): partial ones of a chunk follow one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, t, held, done = None, None, None, []

        def ended() -> pa.RecordBatch:
            names = [pa.array([a[k] for a, times, _ in done for _ in times]) for k in keys]
            arrays = [*names, pa.array(np.concatenate([times for _, times, _ in done]), pa.int64()), pa.array([o for _, _, out in done for o in out], pa.list_(pa.float64()))]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[*keys, "t", "o"])

        for batch in batches:
            for r in batch.to_pylist():
                name, times = {k: r[k] for k in (*keys, "i")}, np.array(r["t"])
                order = np.argsort(times, kind="stable")
                own = Partial(*(np.array(r[c]).reshape(len(times), heads, *([-1] if c == "sums" else []))[order] for c in ("top", "total", "sums")))
                if name != at:
                    if held is not None:
                        done.append((at, t, held.out()))
                    if len(done) >= TOGETHER:
                        yield ended()
                    at, t, held = name, times[order], own
                else:
                    held = held.merged(own)
        if held is not None:
            done.append((at, t, held.out()))
            yield ended()

    return run


def attention(
    df: DataFrame, keys: list[str], t: str, q: str, k: str, v: str, scale: float, causal: bool = True, out: str = "o",
    heads: int = 1, groups: int | None = None, past: DataFrame | None = None, chunk: int = CHUNK,
) -> DataFrame:
    """df with the attention of each row's query over the rows of its key, itself and those before if causal.

    q holds the heads' queries one after another, k and v those of the groups; head h reads group h * groups // heads (groups: as
    many as heads). past(keys, t, k, v) are rows from before, such as a cache of what was seen: t of df goes on after them. t is unique in a key.
    Work grows with the square of a sequence, what is shuffled with the square over the chunk's length; pairs of chunks of one key are many tasks.
    """
    groups = groups or heads
    if heads % groups:
        raise ConfigError(f"{heads} heads for {groups} groups")
    # Keys as strings that are never null: equal ones meet in plain joins, which Spark can split.
    named = [f"key{i}" for i in range(len(keys))]
    coded = lambda name: F.when(F.col(name).isNull(), "").otherwise(F.concat(F.lit("="), F.col(name).cast("string")))
    at, own = F.floor(F.col(t) / chunk).cast("bigint"), [coded(x).alias(n) for x, n in zip(keys, named)]
    time, doubles = F.col(t).cast("bigint").alias("t"), lambda name, to: F.col(name).cast("array<double>").alias(to)
    queries = df.select(*own, at.alias("i"), F.struct(time, doubles(q, "q")).alias("r")).groupBy(*named, "i").agg(F.sort_array(F.collect_list("r")).alias("queries"))
    both = df.select(*keys, t, k, v) if past is None else df.select(*keys, t, k, v).unionByName(past.select(*keys, t, k, v))
    seen = both.select(*own, at.alias("j"), F.struct(time, doubles(k, "k"), doubles(v, "v")).alias("r")).groupBy(*named, "j").agg(F.collect_list("r").alias("seen"))
    present = both.select(*own, at.alias("j")).distinct()
    asked = df.select(*own, at.alias("i")).distinct()
    met: list[Column] = [F.col(n) == F.col(f"{n}_") for n in named]
    pairs = asked.join(present.withColumnsRenamed({n: f"{n}_" for n in named}), met + ([F.col("j") <= F.col("i")] if causal else [])).select(*named, "i", "j")
    given = pairs.join(seen, [*named, "j"]).join(queries, [*named, "i"]).select(*named, "i", "queries", "seen")
    kind = T.StructType([T.StructField(n, T.StringType()) for n in named] + [T.StructField("i", T.LongType()), T.StructField("t", T.ArrayType(T.LongType()))] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("top", "total", "sums")])
    partial = given.mapInArrow(_partials(named, scale, heads, groups, causal), kind)
    merged = partial.repartition(*named, "i").sortWithinPartitions(*named, "i")
    found = merged.mapInArrow(_merge(named, heads), T.StructType([*kind.fields[: len(named)], T.StructField("t", T.LongType()), T.StructField("o", T.ArrayType(T.DoubleType()))]))
    found = found.select(*[F.col(n).alias(f"_{n}") for n in named], F.col("t").alias("_t"), F.col("o").alias(f"_{out}"))
    on = [coded(x) == F.col(f"_{n}") for x, n in zip(keys, named)] + [F.col(t) == F.col("_t")]
    return df.join(found, on).select(*df.columns, F.col(f"_{out}").alias(out))
