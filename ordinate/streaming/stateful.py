"""Attention and the whole recurrence on streams, with list and map states on RocksDB.

A state is kept by key. What grows with a sequence, an attention's keys and values, is appended to a list and read back piece by piece; nothing of
it is rewritten by a trigger. The recurrence's state may come from a batch scan. Rows of a trigger come in any order; those of one key are put
in order by runs of bounded size, which lie in the state until they are merged, so that no more than a piece of each is held.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..errors import ConfigError
from ..functions.scalar import number
from ..operators.attention import Partial
from .run import shared_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a piece: of a cached list, of a block of queries, and of a run of unsorted rows that is read back.
PIECE = 512
TWO_PI, FLOOR = 6.283185307179586, -60.0
ARRAY = T.ArrayType(T.DoubleType())


@contextmanager
def rocksdb(spark: SparkSession):
    """Within it, streams that start keep their state on RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def in_parts(parts: list[DataFrame], transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What transform yields of a stream that is stopped after each part and goes on from its checkpoint with the next, as a table."""
    spark, kind = parts[0].sparkSession, parts[0].schema
    path = shared_path(spark, "parts")
    out = None
    for part in parts:
        part.write.mode("append").parquet(f"{path}-in")
        with rocksdb(spark):
            out = transform(spark.readStream.schema(kind).parquet(f"{path}-in"))
            run = out.writeStream.format("parquet").option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start(path)
            run.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def _stacked(column: pd.Series | np.ndarray) -> np.ndarray:
    """[rows, values] of a column of arrays, or of arrays of arrays, laid end to end."""
    return np.array([np.concatenate([np.asarray(y, float).ravel() for y in x]) if len(x) and np.ndim(x[0]) else np.asarray(x, float) for x in column], float)


def _coded(keys: list[str]) -> list[Column]:
    """Keys as strings that are never null, as a processor takes them: nulls of numbers would be told apart."""
    return [F.when(F.col(k).isNull(), "").otherwise(F.concat(F.lit("="), F.col(k).cast("string"))).alias(f"key{i}_") for i, k in enumerate(keys)]


def _decoded(out: DataFrame, keys: list[str], like: DataFrame) -> DataFrame:
    own = [F.when(F.col(f"key{i}_") != "", F.substring(f"key{i}_", 2, 1 << 30)).cast(like.schema[k].dataType).alias(k) for i, k in enumerate(keys)]
    return out.select(*own, *[c for c in out.columns if not re.fullmatch(r"key\d+_", c)])


def _key_columns(keys: list[str], key: tuple, n: int) -> dict[str, pd.Series]:
    """Plain objects: strings in Arrow's own arrays would come in chunks, which the serializer doesn't take."""
    return {c: pd.Series([v] * n, dtype=object) for c, v in zip(keys, key)}


class _Attention(StatefulProcessor):
    """Rows' keys and values are appended to a list; queries wait in another until all rows of the trigger are there."""

    def __init__(self, keys: list[str], scale: float, heads: int, groups: int) -> None:
        self.keys, self.scale, self.heads, self.groups = keys, scale, heads, groups

    def init(self, handle: StatefulProcessorHandle) -> None:
        piece = T.StructType([T.StructField("t", T.ArrayType(T.LongType())), T.StructField("a", ARRAY), T.StructField("b", ARRAY)])
        self.seen, self.waiting = handle.getListState("seen", piece), handle.getListState("waiting", piece)
        self.last = handle.getValueState("last", T.StructType([T.StructField("t", T.LongType())]))

    def _over(self, t: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The attention of a block of queries, piece by piece of what was seen, with a running maximum."""
        held = None
        for at, k, v in self.seen.get():
            own = Partial.of(q, np.array(k).reshape(len(at), -1), np.array(v).reshape(len(at), -1), np.array(at) <= t[:, None], self.scale, self.heads, self.groups)
            held = own if held is None else held.merged(own)
        return held.out()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.last.get()
        last = held[0] if held is not None else None
        greatest, asked, waits = last, None, False
        for batch in rows:
            if batch.empty:
                continue
            times, columns = batch["t_"].to_numpy(), [batch[c].to_numpy() for c in ("k_", "v_", "q_")]
            if last is not None and (late := times <= last).any():
                yield self._frame(key, times[late], [None] * int(late.sum()), True)
                times, columns = times[~late], [c[~late] for c in columns]
            for start in range(0, len(times), PIECE):
                t = times[start : start + PIECE].tolist()
                k, v, q = (_stacked(c[start : start + PIECE]) for c in columns)
                self.seen.appendValue((t, k.ravel().tolist(), v.ravel().tolist()))
                if asked is not None:  # one piece of queries is held, the others lie in the state
                    self.waiting.appendValue((asked[0].tolist(), asked[1].ravel().tolist(), []))
                    waits = True
                asked = np.array(t), q
                greatest = max(t) if greatest is None else max(greatest, *t)
        if waits:
            for t, q, _ in self.waiting.get():
                yield self._frame(key, np.array(t), list(self._over(np.array(t), np.array(q).reshape(len(t), -1))), False)
            self.waiting.clear()
        if asked is not None:
            yield self._frame(key, asked[0], list(self._over(*asked)), False)
        if greatest is not None:
            self.last.update((int(greatest),))

    def _frame(self, key: tuple, t: np.ndarray, o: list, late: bool) -> pd.DataFrame:
        return pd.DataFrame({**_key_columns(self.keys, key, len(t)), "t": t, "o": o, "late": late})

    def close(self) -> None:
        pass


def attention(stream: DataFrame, keys: list[str], t: str, q: str, k: str, v: str, scale: float, heads: int = 1, groups: int | None = None) -> DataFrame:
    """(keys, t, o, late) of a stream: o is the causal attention of a row's query over the rows of its key up to t, in this and earlier triggers.

    q, k and v as for the batch operator; a trigger's rows may come in any order, and rows of equal t see each other. A row that is not after all rows
    of earlier triggers is late: it comes out without o and is not kept, as rows that should have seen it are out. What is kept of a key grows with it.
    """
    groups = groups or heads
    if heads % groups:
        raise ConfigError(f"{heads} heads for {groups} groups")
    names = [f"key{i}_" for i in range(len(keys))]
    rows = stream.select(*_coded(keys), F.col(t).cast("bigint").alias("t_"), F.col(q).alias("q_"), F.col(k).alias("k_"), F.col(v).alias("v_"))
    kind = T.StructType([rows.schema[c] for c in names] + [T.StructField("t", T.LongType()), T.StructField("o", ARRAY), T.StructField("late", T.BooleanType())])
    return _decoded(rows.groupBy(*names).transformWithStateInPandas(_Attention(names, scale, heads, groups), kind, "append", "None"), keys, stream)


class _InOrder:
    """Rows of a key's trigger in order of t: a sorted run a batch, in the state; one piece of each run is held at a time."""

    def __init__(self, handle: StatefulProcessorHandle, fields: list[str]) -> None:
        place = T.StructType([T.StructField("run", T.LongType()), T.StructField("piece", T.LongType())])
        piece = T.StructType([T.StructField("t", T.ArrayType(T.LongType())), T.StructField("width", T.ArrayType(T.LongType())), T.StructField("values", ARRAY)])
        self.runs, self.fields = handle.getMapState("runs", place, piece), fields

    def _rows(self, batch: pd.DataFrame) -> Iterator[tuple[int, list[np.ndarray]]]:
        batch = batch.sort_values("t_", kind="stable")
        columns = [_stacked(batch[c]) if c in ("x_", "b_", "c_") else batch[c].to_numpy(float)[:, None] for c in self.fields]
        for i, t in enumerate(batch["t_"].tolist()):
            yield t, [c[i] for c in columns]

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[np.ndarray]]]:
        batches = (b for b in batches if not b.empty)
        first = next(batches, None)
        if first is None:
            return
        following = next(batches, None)
        if following is None:
            yield from self._rows(first)
            return
        counts: list[int] = []
        for batch in self._chain(first, following, batches):
            rows = list(self._rows(batch))
            for k in range(0, len(rows), PIECE):
                part = rows[k : k + PIECE]
                values = np.concatenate([np.concatenate(r) for _, r in part])
                self.runs.updateValue((len(counts), k // PIECE), ([t for t, _ in part], [len(x) for x in part[0][1]], values.tolist()))
            counts.append(-(-len(rows) // PIECE))
        yield from heapq.merge(*(self._run(k, n) for k, n in enumerate(counts)), key=lambda r: r[0])

    @staticmethod
    def _chain(first: pd.DataFrame, second: pd.DataFrame, rest: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield first
        yield second
        yield from rest

    def _run(self, run: int, pieces: int) -> Iterator[tuple[int, list[np.ndarray]]]:
        for k in range(pieces):
            t, width, values = self.runs.getValue((run, k))
            self.runs.removeKey((run, k))
            rows = np.array(values).reshape(len(t), -1)
            cuts = np.cumsum(width)[:-1]
            for at, row in zip(t, rows):
                yield at, np.split(row, cuts)


class _Steps(StatefulProcessor):
    """h <- decay h + before last_u + now u, one row at a time; B and C turn by an angle."""

    def __init__(self, keys: list[str], rank: int | None, turning: bool, skip: float, most: int) -> None:
        self.keys, self.rank, self.turning, self.skip, self.most = keys, rank, turning, skip, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        held = [("t", T.LongType()), ("h", ARRAY), ("last_u", ARRAY), ("angle", T.DoubleType())]
        self.state = handle.getValueState("state", T.StructType([T.StructField(n, k) for n, k in held]))
        self.ordered = _InOrder(handle, ["x_", "b_", "c_", "dt_", "lam_", "rate_", "theta_"])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        t, h, last_u, angle = (initialState[c].iloc[0] for c in ("t", "h", "last_u", "angle"))
        self.state.update((int(t), [float(v) for v in h], [float(v) for v in last_u], float(angle)))

    def _turned(self, v: np.ndarray, angle: float) -> np.ndarray:
        half = v.shape[1] // 2
        first, second = v[:, :half], v[:, half:]
        return np.concatenate([first * np.cos(angle) + second * np.sin(angle), second * np.cos(angle) - first * np.sin(angle)], 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get()  # each call to the state store is a round trip to the JVM
        last, h, before_u, angle = held if held is not None else (None, None, None, 0.0)
        rank, start, out = self.rank or 1, last, []
        for t, (x, b, c, dt, lam, rate, theta) in self.ordered(rows):
            if start is not None and t <= start:
                out.append((t, None, True))
            else:
                x, b, c, dt, lam = x.reshape(rank, -1), b.reshape(rank, -1), c.reshape(rank, -1), dt[0], lam[0]
                if self.turning:
                    angle = angle + dt * theta[0]
                    angle -= np.round(angle / TWO_PI) * TWO_PI
                    b, c = self._turned(b, angle), self._turned(c, angle)
                u = x.T @ b
                if h is None:
                    h = before_u = np.zeros(u.shape)
                decay = np.exp(np.clip(dt * rate[0], FLOOR, 0.0))
                h = decay * np.reshape(h, u.shape) + (1 - lam) * dt * decay * np.reshape(before_u, u.shape) + lam * dt * u
                y, before_u, last = c @ h.T + self.skip * x, u, t
                out.append((t, [list(r) for r in y] if self.rank else list(y[0]), False))
            if len(out) >= self.most:
                yield self._frame(key, out)
                out = []
        if h is not None:
            self.state.update((int(last), np.ravel(h).tolist(), np.ravel(before_u).tolist(), float(angle)))
        yield self._frame(key, out)

    def _frame(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        t, y, late = zip(*out) if out else ((), (), ())
        values = {"t": pd.Series(t, dtype="int64"), "y": pd.Series(y, dtype=object), "late": pd.Series(late, dtype=bool)}
        return pd.DataFrame(_key_columns(self.keys, key, len(out)) | values)

    def close(self) -> None:
        pass


def last_states(scanned: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """(keys, t, h, last_u, angle): what a stream needs to go on after the last rows of a batch scan()."""
    angle = F.col("phi") if "phi" in scanned.columns else number(0)
    last = F.max_by(F.struct(F.col(t).cast("bigint").alias("t"), "h", F.col("u").alias("last_u"), angle.alias("angle")), t)
    return scanned.groupBy(*keys).agg(last.alias("_s")).select(*keys, "_s.t", "_s.h", "_s.last_u", "_s.angle")


def steps(
    stream: DataFrame, keys: list[str], t: str = "t", x: str = "x", b: str = "b", c: str = "c", dt: str = "dt", lam: str = "lam", rate: str = "rate",
    skip: float = 0.0, theta: str | None = None, rank: int | None = None, state: DataFrame | None = None, most: int = 1000,
) -> DataFrame:
    """(keys, t, y, late) of a stream: y is that of the batch scan(), with array states, turning by theta, a rank of inputs and outputs, and a skip.

    state: last_states() of a batch scan, from which its sequences go on. Rows of a trigger may come in any order; one that is not after all
    of earlier triggers or of state is late, comes out without y and changes nothing. Rows of a key with equal t follow one another in any order.
    """
    if rank is not None and rank < 1:
        raise ConfigError(f"rank {rank}")
    given = {"t": F.col(t).cast("bigint"), "x": F.col(x), "b": F.col(b), "c": F.col(c)} | {n: F.col(v).cast("double") for n, v in (("dt", dt), ("lam", lam), ("rate", rate))}
    angle = F.col(theta).cast("double") if theta else number(0)
    names = [f"key{i}_" for i in range(len(keys))]
    rows = stream.select(*_coded(keys), *[v.alias(f"{n}_") for n, v in given.items()], angle.alias("theta_"))
    y = T.ArrayType(ARRAY) if rank else ARRAY
    kind = T.StructType([rows.schema[k] for k in names] + [T.StructField("t", T.LongType()), T.StructField("y", y), T.StructField("late", T.BooleanType())])
    held = state.select(*_coded(keys), "t", "h", "last_u", "angle").groupBy(*names) if state is not None else None
    out = rows.groupBy(*names).transformWithStateInPandas(_Steps(names, rank, theta is not None, skip, most), kind, "append", "None", initialState=held)
    return _decoded(out, keys, stream)
