"""Keyed sequences: positions, causal convolution, and the trapezoidal linear recurrence.

A sequence is the rows of a key in order of t = 0, 1, ... The recurrence is

    h[t] = a[t] h[t-1] + b[t] U[t-1] + g[t] U[t],   y[t] = C[t] . h[t],

where U = x (outer) B, a = exp(dt A), b = (1 - lambda) dt a and g = lambda dt. A state is an array of P * N values.

scan() works in chunks of bounded length, so that a key of any length is many tasks: states within a chunk by a fold
from zero, then the chunks' own recurrence (a chunk multiplies what comes in by its decay and adds its last state) by
the same operator, and last what each chunk adds to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions.arrays import plus, rotate_halves
from ..functions.scalar import clamp, number, sigmoid, softplus, wrap_to
from .attention import attention  # noqa: F401  (an operator of sequences, too)

#: Rows of a chunk of the scan. Decays below exp(FLOOR) count as that.
CHUNK, FLOOR = 64, -60.0
TWO_PI = 6.283185307179586


def positions(df: DataFrame, keys: list[str], order: list[str], name: str = "t", parts: Column | None = None) -> DataFrame:
    """df with the rank of each row in its key, from 0. order should be unique in a key.

    parts: a column that ascends with the order, such as the day of a time. Ranks then count within a part, and each part adds the
    rows that its key has in the parts before, so that a key of any size is spread.
    """
    if parts is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
    cut = df.withColumn("_part", parts)
    ranked = cut.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    counts = cut.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    renamed = starts.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_start")
    on = [F.col("_part").eqNullSafe(F.col("_p"))] + [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    out = ranked.join(renamed, on).withColumn(name, (F.col("_own") - 1 + F.col("_start")).cast("bigint"))
    return out.select(*df.columns, name)


def running_sum(df: DataFrame, keys: list[str], t: str, value: str, out: str, chunk: int = 4096) -> DataFrame:
    """df with the sum of a column up to each row: within chunks, plus the chunks before."""
    cut = df.withColumn("_chunk", F.floor(F.col(t) / chunk))
    own = cut.withColumn("_own", F.sum(value).over(Window.partitionBy(*keys, "_chunk").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)))
    sums = cut.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), number(0)))
    renamed = starts.select(F.col("_chunk").alias("_c"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_start")
    on = [F.col("_chunk") == F.col("_c")] + [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return own.join(renamed, on).withColumn(out, F.col("_own") + F.col("_start")).select(*df.columns, out)


def outer(x: Column, b: Column) -> Column:
    """The outer product of two arrays, row-major, as an array."""
    return F.flatten(F.transform(x, lambda p: F.transform(b, lambda n: p * n)))


def read_out(h: Column, c: Column) -> Column:
    """C . h for a row-major state of rows as long as c: an array with a value for each row."""
    n = F.size(c)
    rows = F.sequence(F.lit(0), (F.size(h) / n).cast("int") - 1)
    return F.transform(rows, lambda p: F.aggregate(F.zip_with(F.slice(h, p * n + 1, n), c, lambda u, v: u * v), number(0), lambda s, x: s + x))


def coefficients(dt: Column, a: Column, lam: Column) -> tuple[Column, Column, Column, Column]:
    """(log decay, decay, b, g) of the recurrence for the step dt, the rate A < 0 and lambda."""
    log_decay = clamp(dt * a, FLOOR, 0.0)
    decay = F.exp(log_decay)
    return log_decay, decay, (1 - lam) * dt * decay, lam * dt


def trapezoid_weights(df: DataFrame, keys: list[str], t: str = "t", dt: str = "dt", lam: str = "lam") -> DataFrame:
    """df with g = lambda dt and w = g + (1 - lambda) dt of the row after (0 after the last)."""
    given = df.withColumns({"g": F.col(lam) * F.col(dt), "_share": (1 - F.col(lam)) * F.col(dt), "_back": -F.col(t)})
    given = with_previous(given, keys, "_back", {"_after": "_share"})
    return given.withColumn("w", F.col("g") + F.coalesce("_after", number(0))).select(*df.columns, "g", "w")


def wrapped_angle(df: DataFrame, keys: list[str], t: str = "t", dt: str = "dt", theta: str = "theta", start: Column | None = None) -> DataFrame:
    """df with phi, the angle that dt * theta adds up to, wrapped to [-pi, pi]."""
    given = running_sum(df.withColumn("_turn", F.col(dt) * F.col(theta)), keys, t, "_turn", "_total")
    total = F.col("_total") + start if start is not None else F.col("_total")
    return given.withColumn("phi", wrap_to(total, TWO_PI)).drop("_turn", "_total")


def linear_scan(df: DataFrame, keys: list[str], t: str, log_decay: str, inputs: str, out: str = "h", chunk: int = CHUNK, most: int | None = None) -> DataFrame:
    """df with the states h[t] = exp(log_decay[t]) h[t-1] + inputs[t], arrays that start from zeros.

    t counts from 0 in each key without gaps. No task holds more than a chunk of a key at a time. The longest
    sequence is looked up unless most says it.
    """
    if chunk < 1:
        raise ConfigError(f"chunks of {chunk}")
    if most is None:
        most = (df.agg(F.max(t)).first()[0] or 0) + 1
    columns = [c for c in df.columns if c != out]
    packed = df.select(*keys, F.floor(F.col(t) / chunk).cast("bigint").alias("_chunk"), F.struct(F.col(t).alias("_t"), F.col(log_decay).alias("_d"), F.col(inputs).alias("_u"), F.struct(*columns).alias("_row")).alias("_s"))
    rows = packed.groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_list("_s"), lambda x, y: F.when(x["_t"] < y["_t"], -1).when(x["_t"] > y["_t"], 1).otherwise(0)).alias("_rows"))

    def step(acc: Column, s: Column) -> Column:
        h = F.zip_with(acc.h, s["_u"], lambda p, u: F.exp(s["_d"]) * p + u)
        total = acc.total + s["_d"]
        return F.struct(h.alias("h"), total.alias("total"), F.concat(acc.out, F.array(F.struct(h.alias("h"), total.alias("total")))).alias("out"))

    first = F.col("_rows")[0]["_u"]
    zero = F.struct(
        F.transform(first, lambda _: number(0)).alias("h"), number(0).alias("total"), F.expr("cast(array() as array<struct<h: array<double>, total: double>>)").alias("out")
    )
    folded = rows.withColumn("_fold", F.aggregate("_rows", zero, step))
    if most <= chunk:
        spread = folded.select(F.explode(F.arrays_zip(F.col("_rows").alias("r"), F.col("_fold.out").alias("o"))).alias("_z"))
        return spread.select(*[F.col(f"_z.r._row.{c}").alias(c) for c in columns], F.col("_z.o.h").alias(out))
    chunks = folded.select(*keys, "_chunk", F.col("_fold.total").alias("_total"), F.col("_fold.h").alias("_last"))
    ends = linear_scan(chunks, keys, "_chunk", "_total", "_last", "_end", max(chunk, CHUNK), -(-most // chunk))
    carried = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col("_chunk") + 1).alias("_next"), "_end")
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_chunk") == F.col("_next")]
    met = folded.join(carried, on, "left")
    spread = met.select("_end", F.explode(F.arrays_zip(F.col("_rows").alias("r"), F.col("_fold.out").alias("o"))).alias("_z"))
    more = F.zip_with(F.col("_z.o.h"), F.col("_end"), lambda h, e: h + F.exp(F.greatest(F.col("_z.o.total"), number(FLOOR))) * e)
    h = F.when(F.col("_end").isNull(), F.col("_z.o.h")).otherwise(more)
    return spread.select(*[F.col(f"_z.r._row.{c}").alias(c) for c in columns], h.alias(out))


def linear_scan_gradient(df: DataFrame, keys: list[str], t: str, log_decay: str, gradient: str, out: str = "gu", chunk: int = CHUNK) -> DataFrame:
    """df with the gradients of linear_scan()'s inputs, given those of its states (arrays): a scan from the last row to the first."""
    last = df.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]).agg(F.max(t).alias("_last"))
    back = df.join(last, [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]).withColumn("_r", F.col("_last") - F.col(t))
    back = with_previous(back.drop("_last", *[f"_g{i}" for i in range(len(keys))]), keys, "_r", {"_after": log_decay})
    back = back.withColumn("_after", F.coalesce("_after", number(0)))
    return linear_scan(back, keys, "_r", "_after", gradient, out, chunk).select(*df.columns, out)


def with_previous(df: DataFrame, keys: list[str], t: str, columns: dict[str, str], chunk: int = CHUNK) -> DataFrame:
    """df with the values of the row before (null for the first): columns maps new names to columns.

    Windows are of a chunk and the row before it, which is handed over, so that long keys are spread.
    """
    copies = df.select(*keys, F.col(t), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns.values())])
    last = copies.where(F.pmod(F.col(t) + 1, F.lit(chunk)) == 0)
    over = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], (F.col(t) + 1).alias("_t"), *[F.col(f"_v{i}").alias(f"_w{i}") for i in range(len(columns))])
    w = Window.partitionBy(*keys, F.floor(F.col(t) / chunk)).orderBy(t)
    near = df.withColumns({f"_n{i}": F.lag(c).over(w) for i, c in enumerate(columns.values())})
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col(t) == F.col("_t")]
    out = near.join(over, on, "left")
    return out.select(*df.columns, *[F.coalesce(f"_n{i}", f"_w{i}").alias(name) for i, name in enumerate(columns)])


def scan(
    df: DataFrame,
    keys: list[str],
    t: str = "t",
    x: str = "x",
    b: str = "b",
    c: str = "c",
    dt: str = "dt",
    lam: str = "lam",
    rate: str = "rate",
    skip: float | None = None,
    state: DataFrame | None = None,
    chunk: int = CHUNK,
    theta: str | None = None,
    rank: int | None = None,
) -> DataFrame:
    """df with y (array, one value for each of x), h (the state after each row) and u (what the row adds, x (outer) b).

    x, b and c are arrays (b and c equally long), rate is A < 0. skip adds skip * x to y. With a rank, x, b and c are arrays of so
    many arrays, u is the sum of the outer products of x[j] and b[j], and y[i] reads the one state by c[i]. theta names the
    rate at which the state turns: b and c are turned back by the angle that dt * theta has added up to, which comes as phi.
    state(keys, h, last_u, angle) resumes sequences after the row before the first of df; see final_states().
    """
    if rank is not None and rank < 1:
        raise ConfigError(f"rank {rank}")
    log_decay, decay, before, now = coefficients(F.col(dt), F.col(rate), F.col(lam))
    given = df
    if state is not None:
        on = [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(keys)]
        angle = F.col("angle") if "angle" in state.columns else number(0)
        held = state.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], F.col("h").alias("_h0"), F.col("last_u").alias("_u0"), angle.alias("_a0"))
        given = given.join(held, on, "left").drop(*[f"_s{i}" for i in range(len(keys))])
    if theta is not None:
        given = wrapped_angle(given, keys, t, dt, theta, F.coalesce("_a0", number(0)) if state is not None else None)

    def parts(name: str, turned: bool) -> list[Column]:
        found = [F.get(F.col(name), F.lit(j)) for j in range(rank)] if rank is not None else [F.col(name)]
        if not turned or theta is None:
            return found
        half = lambda v, f: F.transform(F.slice(v, F.lit(1), (F.size(v) / 2).cast("int")), lambda _: f)
        return [rotate_halves(v, half(v, F.cos("phi")), half(v, -F.sin("phi"))) for v in found]

    products = [outer(p, q) for p, q in zip(parts(x, False), parts(b, True))]
    given = given.withColumn("u", plus(*products) if len(products) > 1 else products[0])
    given = with_previous(given, keys, t, {"_before": "u"}, chunk)
    zeros = F.transform("u", lambda _: number(0))
    first = F.col("_u0") if state is not None else F.lit(None).cast("array<double>")
    previous = F.coalesce("_before", F.when(F.col(t) == 0, first), zeros)
    inputs = F.zip_with(F.transform(previous, lambda v: v * before), F.transform("u", lambda v: v * now), lambda p, q: p + q)
    if state is not None:
        start = F.coalesce(F.when(F.col(t) == 0, F.col("_h0")), zeros)
        inputs = F.zip_with(inputs, start, lambda p, s: p + decay * s)
    given = given.withColumns({"_d": log_decay, "_in": inputs})
    states = linear_scan(given, keys, t, "_d", "_in", "h", chunk)
    read = [read_out(F.col("h"), q) for q in parts(c, True)]
    if skip is not None:
        read = [F.zip_with(y, p, lambda v, w: v + skip * w) for y, p in zip(read, parts(x, False))]
    y = F.array(*read) if rank is not None else read[0]
    return states.select(*df.columns, y.alias("y"), "h", "u", *(["phi"] if theta is not None else []))


def mimo_scan(df: DataFrame, keys: list[str], rank: int, **how) -> DataFrame:
    """scan() for rank inputs and outputs with one state."""
    return scan(df, keys, rank=rank, **how)


def final_states(scanned: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """(keys, h, last_u, angle): the resume state after each sequence's last row of scan()."""
    angle = F.col("phi") if "phi" in scanned.columns else number(0)
    last = F.max_by(F.struct("h", "u", angle.alias("angle")), t)
    return scanned.groupBy(*keys).agg(last.alias("s")).select(*keys, F.col("s.h").alias("h"), F.col("s.u").alias("last_u"), F.col("s.angle").alias("angle"))


def scan_band(df: DataFrame, keys: list[str], t: str, log_decay: str, inputs: str, out: str = "h") -> DataFrame:
    """The same states (of scalar inputs) by a band join of each row with the rows before: for short sequences."""
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    given = df.withColumn("_total", F.sum(log_decay).over(w))
    left = given.alias("l")
    right = given.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(t).alias("_s"), F.col("_total").alias("_from"), F.col(inputs).alias("_u"))
    on = [F.col(f"l.{k}") == F.col(f"_k{i}") for i, k in enumerate(keys)] + [F.col("_s") <= F.col(f"l.{t}")]
    decay = F.exp(clamp(F.col("_total") - F.col("_from"), FLOOR, 0.0))
    sums = left.join(right, on).groupBy(*[F.col(f"l.{c}") for c in df.columns]).agg(F.sum(decay * F.col("_u")).alias(out))
    return sums


def band(df: DataFrame, keys: list[str], chunk: int, t: str = "t", log_decay: str = "log_decay", w: str = "w", g: str = "g") -> DataFrame:
    """(keys, k, t, s, weight) for s <= t within chunks: g on the diagonal, w below, times the decay from s to t."""
    given = df.withColumn("k", F.floor(F.col(t) / chunk).cast("bigint"))
    own = Window.partitionBy(*keys, "k").orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    given = given.withColumn("_sum", F.sum(log_decay).over(own))
    right = given.select(*[F.col(x).alias(f"_{x}") for x in keys], F.col("k").alias("_k"), F.col(t).alias("s"), F.col("_sum").alias("_from"), F.col(w).alias("_w"), F.col(g).alias("_g"))
    on = [F.col(x) == F.col(f"_{x}") for x in keys] + [F.col("k") == F.col("_k"), F.col("s") <= F.col(t)]
    weight = F.when(F.col("s") == F.col(t), F.col("_g")).otherwise(F.col("_w")) * F.exp(clamp(F.col("_sum") - F.col("_from"), FLOOR, 0.0))
    return given.join(right, on).select(*keys, "k", F.col(t).alias("t"), "s", weight.alias("weight"))


def causal_conv(df: DataFrame, keys: list[str], t: str, x: str, weights: list[float], bias: float = 0.0, history: DataFrame | None = None, out: str = "y") -> DataFrame:
    """df with the causal convolution of a column: weights[-1] is that of the row itself.

    history(keys, back, x) holds rows before the first: back 1 is the last of them. Missing rows are zeros.
    """
    k = len(weights)
    w = Window.partitionBy(*keys).orderBy(t)
    terms = number(bias)
    given = df
    if history is not None:
        past = history.groupBy(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(keys)]).agg(F.map_from_entries(F.collect_list(F.struct("back", F.col("x").alias("v")))).alias("_past"))
        given = df.join(past, [F.col(c).eqNullSafe(F.col(f"_h{i}")) for i, c in enumerate(keys)], "left")
    for j, weight in enumerate(weights):
        back = k - 1 - j
        v = F.col(x) if not back else F.lag(x, back).over(w)
        if back and history is not None:
            v = F.coalesce(v, F.try_element_at("_past", (F.lit(back) - F.col(t)).cast("int")))
        terms = terms + float(weight) * F.coalesce(v, number(0))
    return given.withColumn(out, terms).select(*df.columns, out)


def conv_history(df: DataFrame, keys: list[str], t: str, x: str, size: int) -> DataFrame:
    """(keys, back, x): the last size - 1 rows of each sequence, to go on from."""
    w = Window.partitionBy(*keys).orderBy(F.desc(t))
    return df.withColumn("back", F.row_number().over(w)).where(F.col("back") < size).select(*keys, "back", F.col(x).alias("x"))


def discretised(raw_dt: Column, bias: float, raw_lambda: Column | None, fixed: float | None = None) -> tuple[Column, Column]:
    """(dt, lambda) of raw projections: softplus with a bias; a sigmoid, or 1 (Euler), 1/2 (trapezoid) or what fixed says."""
    if (raw_lambda is None) == (fixed is None):
        raise ConfigError("lambda is either projected or fixed")
    return softplus(raw_dt + bias), sigmoid(raw_lambda) if raw_lambda is not None else number(fixed)


