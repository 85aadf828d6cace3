"""The whole recurrence and its gradients over sequences packed to chunks.

Rows are packed to chunks once, by one shuffle of (key, chunk). Each chunk is summed up as if its key began there, at angle 0: how it
turns, decays, and what state it adds. The chunks' own recurrence, a table of a row for each chunk, says in what state and at what angle each one
really begins; run backwards, with what the gradients of the outputs add to the states, it says what flows into each chunk from behind. So each
chunk is then computed by itself, its states again from its first one: no state of a row is ever stored or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError
from ..functions.scalar import number
from ..streaming.run import settled
from .sequence import CHUNK, FLOOR, TWO_PI, linear_scan, running_sum, with_previous

DOUBLES = T.ArrayType(T.DoubleType())
#: Chunks that a task unpacks at a time.
PIECE = 128
_LISTS, _NUMBERS = ("x", "b", "c", "g"), ("dt", "lam", "rate", "theta")


@dataclass
class Chunk:
    """Rows of a chunk in order: x and g [rows, rank, P], b and c [rows, rank, N], the rest a number a row."""

    t: np.ndarray
    x: np.ndarray
    b: np.ndarray
    c: np.ndarray
    g: np.ndarray
    dt: np.ndarray
    lam: np.ndarray
    rate: np.ndarray
    theta: np.ndarray

    def at(self, angle: float) -> Local:
        return Local(self, angle)


def _rotated(v: np.ndarray, angle) -> np.ndarray:
    """The halves of the last axis, turned back by angle."""
    first, second = np.split(v, 2, axis=-1)
    cos, sin = np.cos(angle), np.sin(angle)
    return np.concatenate([first * cos + second * sin, second * cos - first * sin], -1)


class Local:
    """A chunk's rows, given the angle at which it begins."""

    def __init__(self, rows: Chunk, angle: float) -> None:
        self.rows = rows
        self.turning = bool(rows.theta.any()) or angle != 0
        self.phi = angle + np.cumsum(rows.dt * rows.theta)
        self.phi = self.phi - np.round(self.phi / TWO_PI) * TWO_PI
        turn = (lambda v: _rotated(v, self.phi[:, None, None])) if self.turning else (lambda v: v)
        self.b, self.c = turn(rows.b), turn(rows.c)
        self.u = np.einsum("trp,trn->tpn", rows.x, self.b)
        self.log_decay = np.clip(rows.dt * rows.rate, FLOOR, 0.0)
        self.decay, self.total = np.exp(self.log_decay), np.cumsum(self.log_decay)
        self.share = (1 - rows.lam) * rows.dt  # of the row before, less its decay
        n = len(rows.t)
        self.weights = np.tril(np.exp(np.minimum(self.total[:, None] - self.total[None, :], 0.0))) if n else np.zeros((0, 0))

    def states(self, first: np.ndarray | None, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(h, u of the row before) of each row, for the state and the u before the first row (zeros)."""
        zero = np.zeros_like(self.u[:1])
        back = np.concatenate([zero if before is None else before.reshape(zero.shape), self.u[:-1]])
        scale = lambda v: v[:, None, None]
        inputs = scale(self.share * self.decay) * back + scale(self.rows.lam * self.rows.dt) * self.u
        h = np.einsum("ts,spn->tpn", self.weights, inputs)
        return (h if first is None else h + scale(np.exp(self.total)) * first.reshape(zero.shape)), back

    def outputs(self, h: np.ndarray, skip: float) -> np.ndarray:
        return np.einsum("tpn,trn->trp", h, self.c) + skip * self.rows.x

    def gradients(self, h: np.ndarray, back: np.ndarray, first: np.ndarray | None, behind: np.ndarray | None, share_behind: float, skip: float) -> dict[str, np.ndarray]:
        """Of each row's inputs. behind: the gradient of the last row's state that comes from the rows after the chunk."""
        rows, zero = self.rows, np.zeros_like(self.u[:1])
        behind = zero if behind is None else behind.reshape(zero.shape)
        flow = np.einsum("st,spn->tpn", self.weights, np.einsum("trp,trn->tpn", rows.g, self.c))
        flow = flow + np.exp(self.total[-1] - self.total)[:, None, None] * behind
        after = np.concatenate([(self.share * self.decay)[1:, None, None] * flow[1:], share_behind * behind])
        of_u = (rows.lam * rows.dt)[:, None, None] * flow + after
        previous = np.concatenate([zero if first is None else first.reshape(zero.shape), h[:-1]])
        dot = lambda a, b: np.einsum("tpn,tpn->t", a, b)
        with_back, with_own = dot(flow, back), dot(flow, self.u)
        raw = rows.dt * rows.rate
        slope = (dot(flow, previous) + self.share * with_back) * self.decay * ((raw > FLOOR) & (raw < 0))
        of_b, of_c = np.einsum("tpn,trp->trn", of_u, rows.x), np.einsum("tpn,trp->trn", h, rows.g)
        turned = np.zeros(len(rows.t))
        for grad, value in ((of_b, self.b), (of_c, self.c)) if self.turning or rows.b.shape[-1] % 2 == 0 else ():
            (g1, g2), (v1, v2) = np.split(grad, 2, -1), np.split(value, 2, -1)
            turned += (g1 * v2 - g2 * v1).sum((1, 2))
        back_turn = (lambda v: _rotated(v, -self.phi[:, None, None])) if self.turning else (lambda v: v)
        return {
            "gx": np.einsum("tpn,trn->trp", of_u, self.b) + skip * rows.g, "gb": back_turn(of_b), "gc": back_turn(of_c),
            "gdt": slope * rows.rate + (1 - rows.lam) * self.decay * with_back + rows.lam * with_own,
            "glam": rows.dt * (with_own - self.decay * with_back), "grate": slope * rows.dt, "turned": turned,
        }


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows by PIECE at most: a batch of Spark's has 10,000 chunks, whose rows as arrays of their own would be held at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, PIECE):
            yield batch.slice(k, PIECE)


def _chunks(batch: pa.RecordBatch, rank: int) -> Iterator[Chunk]:
    """The chunks of a batch's column rows."""
    lists = batch.column("rows")
    every, ends = lists.flatten(), np.cumsum([0, *lists.value_lengths().to_pylist()])
    for k in range(batch.num_rows):
        own = every.slice(ends[k], ends[k + 1] - ends[k])
        n, t = len(own), own.field("t").to_numpy()
        order = np.argsort(t, kind="stable")
        values = {c: np.array(own.field(c).flatten().to_numpy(zero_copy_only=False), float).reshape(n, rank, -1)[order] for c in _LISTS}
        values |= {c: np.array(own.field(c).to_numpy(zero_copy_only=False), float)[order] for c in _NUMBERS}
        yield Chunk(t[order], **values)


def _kept(batch: pa.RecordBatch, names: list[str]) -> list[pa.Array]:
    return [batch.column(c) for c in names]


def _flat(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.ravel() for r in rows], pa.list_(pa.float64()))


def _summaries(keys: list[str], rank: int):
    """A chunk's turn, decay, share of the row before it, last state and u, what it hands back, all as from angle 0, and its N."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            found: dict[str, list] = {c: [] for c in ("turn", "decay", "share", "h", "u", "back", "n")}
            for rows in _chunks(batch, rank):
                own = rows.at(0.0)
                h, _ = own.states(None, None)
                back = np.einsum("t,trp,trn->pn", np.exp(own.total), rows.g, own.c)
                for c, v in zip(found, (float((rows.dt * rows.theta).sum()), float(own.total[-1]), float(own.share[0]), h[-1], own.u[-1], back, rows.b.shape[-1])):
                    found[c].append(v)
            arrays = [pa.array(found[c], pa.float64()) for c in ("turn", "decay", "share")] + [_flat(found[c]) for c in ("h", "u", "back")] + [pa.array(found["n"], pa.int64())]
            yield pa.RecordBatch.from_arrays(_kept(batch, [*keys, "chunk"]) + arrays, names=[*keys, "chunk", *found])

    return run


def _turned(values: Column, angle: Column, n: Column) -> Column:
    """A state whose rows of n values are turned back by angle."""

    @F.arrow_udf("array<double>")
    def turned(values: pa.Array, angle: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for v, a, m in zip(values, angle.to_pylist(), n.to_pylist()):
            own = v.values.to_numpy()
            out.append(_rotated(own.reshape(-1, m), a).ravel() if a else own)
        return pa.array(out, pa.list_(pa.float64()))

    return turned(values, angle, n)


def _internal(keys: list[str]) -> list[str]:
    """Names that a table of chunks has for keys."""
    return [f"_key{i}" for i in range(len(keys))]


@dataclass
class Packed:
    """Packed rows, and of each chunk where it begins: angle, h and u before it (null: zeros); if asked, what flows in from behind."""

    names: list[str]
    rank: int | None
    rows: DataFrame
    ends: DataFrame

    @property
    def keys(self) -> list[str]:
        return _internal(self.names)

    def joined(self) -> DataFrame:
        on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)] + [F.col("chunk") == F.col("_chunk")]
        ends = self.ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], F.col("chunk").alias("_chunk"), "angle", "first", "before", "behind", "share_behind")
        return self.rows.join(ends, on).select(*self.keys, "chunk", "rows", "angle", "first", "before", "behind", "share_behind")

    def mapped(self, kinds: dict[str, T.DataType], of: Callable) -> DataFrame:
        """(keys, chunk, t, ...) of each row: of(Local, Ends) gives arrays, a row each, by the names of kinds."""
        keys, rank = self.keys, self.rank or 1
        given = self.joined()
        fields = [given.schema[k] for k in keys] + [T.StructField("chunk", T.LongType()), T.StructField("t", T.LongType())]
        flat = {c: DOUBLES if isinstance(k, T.ArrayType) else k for c, k in kinds.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _pieces(batches):
                sizes, times, found = [], [], {c: [] for c in kinds}
                for k, rows in enumerate(_chunks(batch, rank)):
                    ends = {c: batch.column(c)[k].as_py() for c in ("angle", "first", "before", "behind", "share_behind")}
                    ends = {c: np.array(v) if isinstance(v, list) else v for c, v in ends.items()}
                    got = of(rows.at(ends["angle"]), ends)
                    sizes.append(len(rows.t))
                    times.append(rows.t)
                    for c in kinds:
                        found[c].extend(got[c].reshape(len(rows.t), -1) if isinstance(kinds[c], T.ArrayType) else got[c])
                again = np.repeat(np.arange(batch.num_rows), sizes)
                arrays = [batch.column(c).take(pa.array(again)) for c in (*keys, "chunk")] + [pa.array(np.concatenate(times) if times else [], pa.int64())]
                arrays += [pa.array(found[c], pa.list_(pa.float64()) if isinstance(k, T.ArrayType) else pa.float64()) for c, k in kinds.items()]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "chunk", "t", *kinds])

        out = given.mapInArrow(run, T.StructType([*fields, *[T.StructField(c, k) for c, k in flat.items()]]))
        out = out.withColumnsRenamed(dict(zip(keys, self.names)))
        if self.rank is None:
            return out
        rows_of = lambda v: F.transform(F.sequence(F.lit(0), F.lit(rank - 1)), lambda r: F.slice(v, (r * F.size(v) / rank + 1).cast("int"), (F.size(v) / rank).cast("int")))
        return out.withColumns({c: rows_of(F.col(c)) for c, k in kinds.items() if isinstance(k, T.ArrayType) and c not in ("h", "u")})


def pack(
    df: DataFrame, keys: list[str], t: str = "t", x: str = "x", b: str = "b", c: str = "c", dt: str = "dt", lam: str = "lam", rate: str = "rate",
    theta: str | None = None, rank: int | None = None, state: DataFrame | None = None, gradient: str | None = None, chunk: int = CHUNK,
) -> Packed:
    """df packed to chunks, with the chunks' ends. t counts from 0 in each key without gaps. gradient: a column of those of the outputs, as y."""
    if chunk < 1:
        raise ConfigError(f"chunks of {chunk}")
    if rank is not None and rank < 1:
        raise ConfigError(f"rank {rank}")
    flat = lambda name: F.flatten(name) if rank is not None else F.col(name)
    zeros = F.transform(flat(x), lambda _: number(0))
    values = {"x": flat(x), "b": flat(b), "c": flat(c), "g": flat(gradient) if gradient else zeros, "dt": F.col(dt), "lam": F.col(lam), "rate": F.col(rate), "theta": F.col(theta) if theta else number(0)}
    row = F.struct(F.col(t).cast("bigint").alias("t"), *[v.cast(DOUBLES if n in _LISTS else "double").alias(n) for n, v in values.items()])
    names, keys = keys, _internal(keys)
    cut = df.select(*[F.col(k).alias(n) for n, k in zip(keys, names)], F.floor(F.col(t) / chunk).cast("bigint").alias("chunk"), row.alias("row"))
    rows = settled(cut.groupBy(*keys, "chunk").agg(F.collect_list("row").alias("rows")))  # chunk rows at most
    kinds = [("turn", T.DoubleType()), ("decay", T.DoubleType()), ("share", T.DoubleType()), ("h", DOUBLES), ("u", DOUBLES), ("back", DOUBLES), ("n", T.LongType())]
    own = rows.select(*keys, "chunk", "rows").mapInArrow(_summaries(keys, rank or 1), T.StructType([*[rows.schema[k] for k in [*keys, "chunk"]], *[T.StructField(*k) for k in kinds]]))
    own = settled(own)
    most = (own.agg(F.max("chunk")).first()[0] or 0) + 1
    null = F.lit(None).cast(DOUBLES)
    if most == 1 and state is None:
        return Packed(names, rank, rows, own.select(*keys, "chunk", number(0).alias("angle"), null.alias("first"), null.alias("before"), null.alias("behind"), number(0).alias("share_behind")))
    if state is not None:
        on = [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(keys)]
        angle = F.col("angle") if "angle" in state.columns else number(0)
        held = state.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(names)], F.col("h").alias("h0"), F.col("last_u").alias("u0"), angle.alias("angle0"))
        own = own.join(held, on, "left")
    else:
        own = own.withColumns({"h0": null, "u0": null, "angle0": number(0)})
    own = running_sum(own, keys, "chunk", "turn", "upto").withColumn("angle", F.col("upto") - F.col("turn") + F.coalesce("angle0", number(0)))
    own = settled(own.withColumns({c: _turned(F.col(c), F.col("angle"), F.col("n")) for c in (("h", "u", "back") if theta else ())}))
    begins = F.col("chunk") == 0
    own = with_previous(own, keys, "chunk", {"_u": "u"}).withColumn("before", F.coalesce("_u", F.when(begins, F.col("u0"))))
    decay = F.exp("decay")
    added = F.when(F.col("before").isNotNull(), F.zip_with("h", "before", lambda h, u: h + F.col("share") * decay * u)).otherwise(F.col("h"))
    start = F.when(begins, F.col("h0"))
    added = F.when(start.isNotNull(), F.zip_with(added, start, lambda h, s: h + decay * s)).otherwise(added)
    own = settled(linear_scan(own.withColumn("in", added), keys, "chunk", "decay", "in", "end", most=most))
    own = with_previous(own, keys, "chunk", {"_h": "end"}).withColumn("first", F.coalesce("_h", start))
    if gradient is None:
        return Packed(names, rank, rows, settled(own.select(*keys, "chunk", "angle", "first", "before", null.alias("behind"), number(0).alias("share_behind"))))
    last = own.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max("chunk").alias("_last"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    turned = own.join(last, on).select(*keys, "chunk", "angle", "first", "before", "decay", "share", "back", (F.col("_last") - F.col("chunk")).alias("r"))
    flows = settled(linear_scan(settled(turned), keys, "r", "decay", "back", "flow", most=most))
    ends = with_previous(flows, keys, "r", {"behind": "flow", "share_behind": "share"})
    return Packed(names, rank, rows, settled(ends.select(*keys, "chunk", "angle", "first", "before", "behind", F.coalesce("share_behind", number(0)).alias("share_behind"))))


def scan(df: DataFrame, keys: list[str], t: str = "t", skip: float = 0.0, **how) -> DataFrame:
    """(keys, t, y, h, u, phi): the same as sequence.scan(), with the arguments of pack()."""

    def of(own: Local, ends: dict) -> dict[str, np.ndarray]:
        h, _ = own.states(ends["first"], ends["before"])
        return {"y": own.outputs(h, skip), "h": h, "u": own.u, "phi": own.phi}

    kinds = {"y": DOUBLES, "h": DOUBLES, "u": DOUBLES, "phi": T.DoubleType()}
    return pack(df, keys, t, **how).mapped(kinds, of).drop("chunk")


def gradients(df: DataFrame, keys: list[str], gradient: str, t: str = "t", skip: float = 0.0, **how) -> DataFrame:
    """(keys, t, gx, gb, gc, gdt, glam, grate, gtheta): of each row's inputs of scan(), given those of its outputs y.

    gx, gb and gc are arrays as x, b and c. Gradients of what rows share, such as one rate, are the sums of these. A state that sequences go on from is
    taken as given. At a decay that is cut off at exp(FLOOR), the rate has no gradient.
    """

    def of(own: Local, ends: dict) -> dict[str, np.ndarray]:
        h, back = own.states(ends["first"], ends["before"])
        found = own.gradients(h, back, ends["first"], ends["behind"], ends["share_behind"], skip)
        return found | {"dt": own.rows.dt, "theta": own.rows.theta, "later": np.cumsum(found["turned"][::-1])[::-1]}

    single = T.DoubleType()
    kinds = {"gx": DOUBLES, "gb": DOUBLES, "gc": DOUBLES} | {c: single for c in ("gdt", "glam", "grate", "dt", "theta", "turned", "later")}
    found = pack(df, keys, t, gradient=gradient, **how).mapped(kinds, of)
    out = [*keys, "t", "gx", "gb", "gc"]
    if not how.get("theta"):
        return found.select(*out, "gdt", "glam", "grate", number(0).alias("gtheta"))
    # An angle counts in all later rows: those of the chunk, and the sums of the chunks behind.
    found = settled(found)
    sums = settled(found.groupBy(*keys, "chunk").agg(F.sum("turned").alias("turned")))
    last = sums.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max("chunk").alias("_last"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    sums = sums.join(last, on).withColumn("r", F.col("_last") - F.col("chunk")).select(*keys, "chunk", "r", "turned")
    behind = running_sum(settled(sums), keys, "r", "turned", "upto")
    behind = behind.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("chunk").alias("_chunk"), (F.col("upto") - F.col("turned")).alias("behind"))
    every = found.join(behind, [*on, F.col("chunk") == F.col("_chunk")]).withColumn("angle", F.col("later") + F.col("behind"))
    return every.select(*out, (F.col("gdt") + F.col("theta") * F.col("angle")).alias("gdt"), "glam", "grate", (F.col("dt") * F.col("angle")).alias("gtheta"))
