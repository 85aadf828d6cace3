"""Queries of gradients, of resumed and combined scans, of attention, and of blocks, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import CENTROIDS, EVENTS, KERNEL, LAMBDA, LONG, RATE, cells, event_sequences, r6, read
from .frame import TensorFrame
from .functions import scalar
from .functions.permutation import PRIME, Permutation
from .operators import elemwise, packed, sequence
from .plans import autodiff, blocks, sampling, training
from .sources.tables import centroids, vector_tensor, vectors
from .streaming import ranges, stateful
from .streaming.run import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


# Elementwise operators that the other catalog does not apply


@query(f"""
WITH l AS {LONG}, m AS (SELECT i1, avg(v) + 2 AS m FROM l GROUP BY i1)
SELECT i0, i1, round(v / m, 6) + 0.0 AS div, round(least(v, m - 2), 6) + 0.0 AS low, round(pow(abs(v) + 0.5, m), 6) AS pow, round(v * m + v, 6) + 0.0 AS mul_add,
       round(m, 6) AS repeated FROM l JOIN m USING (i1)
""")
def elementwise_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import reduce

    x = vector_tensor(spark, sf_dir)
    means = reduce.mean_dim(x, 0)
    m = TensorFrame(means.df.withColumn("v", F.col("v") + 2).withColumn("i0", F.lit(0).cast("bigint")).select("i0", "i1", "v"), (1, x.shape[1]))
    parts = {
        "div": elemwise.div(x, m), "low": elemwise.minimum(x, m.map(lambda v: v - 2)), "pow": elemwise.powf(x.map(lambda v: F.abs(v) + 0.5), m),
        "mul_add": elemwise.mul_add(x, m, x), "repeated": elemwise.repeat(m, 0, x.shape[0]),
    }
    # The parts are laid one below the other and met by one grouped maximum: no task sorts all of them at once.
    every = None
    for name, t in parts.items():
        df = t.df.select("i0", "i1", F.lit(name).alias("part"), r6("v").alias("v"))
        every = df if every is None else every.union(df)
    return every.groupBy("i0", "i1").agg(*[F.max(F.when(F.col("part") == name, F.col("v"))).alias(name) for name in parts])


@query(f"SELECT i0, i1, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) + 0.0 AS f32 FROM {LONG}")
def precisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vector_tensor(spark, sf_dir)
    return x.df.select("i0", "i1", r6(scalar.rounded(F.col("v"), "float32")).alias("f32"))


# Gradients against their closed forms


@query(f"""
WITH n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), c AS (SELECT doc_id % n AS i0, count(*) AS k FROM labels, n GROUP BY ALL)
SELECT i0, i1, round(2 * v * coalesce(k, 0), 6) + 0.0 AS v FROM {LONG} LEFT JOIN c USING (i0)
""")
def grad_gather_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient of the sum of squares of gathered rows."""
    x = vector_tensor(spark, sf_dir)
    ids = sequence.positions(read(spark, sf_dir, "labels").select("doc_id", F.lit(0).alias("k")), ["k"], ["doc_id"], parts=F.floor(F.col("doc_id") / 1000))
    ids = TensorFrame.of(ids, ["t"], F.pmod("doc_id", F.lit(x.shape[0])), (ids.count(),))
    rows = autodiff.gather_rows(autodiff.Var(x, "x"), ids)
    return cells(autodiff.backward(autodiff.sum_all(autodiff.mul(rows, rows)))["x"])


@query(f"SELECT i0, i1, CASE WHEN i1 = label THEN round(2 * v, 6) + 0.0 ELSE 0.0 END AS v FROM {LONG}")
def grad_take_along_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vector_tensor(spark, sf_dir)
    taken = autodiff.take_along_last(autodiff.Var(x, "x"), TensorFrame.of(vectors(spark, sf_dir), ["vec_id"], "label", x.shape[:1]))
    return cells(autodiff.backward(autodiff.sum_all(autodiff.mul(taken, taken)))["x"])


@query(f"""
WITH w AS (SELECT unnest({KERNEL}) AS w, unnest(range(4)) AS k), l AS MATERIALIZED (SELECT i0, i1, v FROM {LONG}),
y AS MATERIALIZED (SELECT l.i0, l.i1, sum(w.w * p.v) AS y FROM l, w JOIN l p ON p.i0 = l.i0 AND p.i1 = l.i1 - (3 - w.k) GROUP BY ALL)
SELECT k AS i0, round(sum(2 * y * l.v), 5) + 0.0 AS v FROM y, w JOIN l ON l.i0 = y.i0 AND l.i1 = y.i1 - (3 - k) GROUP BY k
""")
def grad_causal_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient of a convolution's weights, for the sum of squares of what it gives along each vector."""
    weights = autodiff.Var(TensorFrame.from_data(spark, KERNEL, (4,)), "w")
    with autodiff.written(settled):  # what several gradients read is a table, so that no task sorts many copies of it
        y = autodiff.causal_conv(autodiff.Var(vector_tensor(spark, sf_dir)), weights, 1)
        g = autodiff.backward(autodiff.sum_all(autodiff.mul(y, y)))["w"]
    return g.df.select("i0", (F.round("v", 5) + 0.0).alias("v"))


@query(f"""
SELECT i0, i1, round(CASE WHEN i1 < 32 THEN (i1 + 1) * cos(0.1 * i1) + (i1 + 33) * sin(0.1 * i1)
                          ELSE -(i1 - 31) * sin(0.1 * (i1 - 32)) + (i1 + 1) * cos(0.1 * (i1 - 32)) END, 6) + 0.0 AS v FROM {LONG}
""")
def grad_rotate_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient of turned vectors, cell k of which counts k + 1."""
    x = vector_tensor(spark, sf_dir)
    of = lambda n, f: autodiff.Var(TensorFrame.generated(spark, (n,), f))
    turned = autodiff.rotate_halves(autodiff.Var(x, "x"), of(32, lambda k: F.cos(k * 0.1)), of(32, lambda k: F.sin(k * 0.1)))
    return cells(autodiff.backward(autodiff.sum_all(autodiff.mul(turned, of(64, lambda k: k + 1.0))))["x"])


@query(f"""
WITH z AS (SELECT a.i0, a.label, b.c, sum(a.v * b.v) AS z FROM {LONG} a JOIN {CENTROIDS} b ON a.i1 = b.d GROUP BY ALL),
p AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY i0) AS p, count(*) OVER (PARTITION BY i0) AS k FROM z),
n AS (SELECT count(*) AS n FROM embeddings WHERE label != 3)
SELECT i0, c AS i1, round(CASE WHEN label = 3 THEN 0 ELSE (p - CASE WHEN c = label THEN 0.9 ELSE 0 END - 0.1 / k) / n END, 8) + 0.0 AS v FROM p, n
""")
def grad_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With smoothing 0.1, rows of class 3 ignored."""
    from .operators import contraction

    x = vector_tensor(spark, sf_dir)
    classes = TensorFrame.of(vectors(spark, sf_dir), ["vec_id"], "label", x.shape[:1])
    with autodiff.written(settled):
        z = autodiff.Var(contraction.matmul_nt(x, centroids(spark, sf_dir)), "z")
        g = autodiff.backward(autodiff.cross_entropy(z, classes, 0.1, ignored=3))["z"]
    return g.df.select("i0", "i1", (F.round("v", 8) + 0.0).alias("v"))


@query(f"""
WITH s AS (SELECT i0, i1, sum(-abs(v)) OVER (PARTITION BY i0 ORDER BY i1) AS a FROM {LONG})
SELECT r.i0, r.i1, round(sum(exp(l.a - r.a)), 6) + 0.0 AS v FROM s l JOIN s r ON l.i0 = r.i0 AND r.i1 <= l.i1 GROUP BY ALL
""")
def grad_linear_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient of a scan's inputs along each vector, for the sum of its states."""
    rows = settled(vector_tensor(spark, sf_dir).df.select("i0", "i1", (-F.abs("v")).alias("d"), F.array(F.lit(1.0)).alias("g")))
    found = sequence.linear_scan_gradient(rows, ["i0"], "i1", "d", "g", chunk=16)
    return found.select("i0", "i1", (F.round(F.col("gu")[0], 6) + 0.0).alias("v"))


@query(f"""
WITH e AS (SELECT user_id, t, x, dt, 1.0 + t % 3 AS g, (event_id % 3) / 3.0 AS b, (event_id % 5) / 5.0 AS c, greatest(-0.1 * dt, -60) AS d, sum(dt * 0.7) OVER (PARTITION BY user_id ORDER BY t) AS phi FROM {EVENTS}),
r AS (SELECT *, cos(phi) AS co, sin(phi) AS si, cos(phi) + b * sin(phi) AS b0, b * cos(phi) - sin(phi) AS b1, cos(phi) + c * sin(phi) AS c0, c * cos(phi) - sin(phi) AS c1 FROM e),
u AS (SELECT *, x * b0 AS u0, x * b1 AS u1, lag(x * b0, 1, 0) OVER w AS p0, lag(x * b1, 1, 0) OVER w AS p1, sum(d) OVER w AS a FROM r WINDOW w AS (PARTITION BY user_id ORDER BY t)),
i AS MATERIALIZED (SELECT *, 0.5 * dt * (exp(d) * p0 + u0) AS i0, 0.5 * dt * (exp(d) * p1 + u1) AS i1 FROM u),
h AS (SELECT l.user_id, l.t, sum(exp(l.a - r.a) * r.i0) AS h0, sum(exp(l.a - r.a) * r.i1) AS h1 FROM i l JOIN i r ON l.user_id = r.user_id AND r.t <= l.t GROUP BY ALL),
f AS (SELECT l.user_id, l.t, sum(exp(r.a - l.a) * r.g * r.c0) AS f0, sum(exp(r.a - l.a) * r.g * r.c1) AS f1 FROM i l JOIN i r ON l.user_id = r.user_id AND r.t >= l.t GROUP BY ALL),
j AS (SELECT *, lag(h0, 1, 0) OVER w AS q0, lag(h1, 1, 0) OVER w AS q1, 0.5 * dt * f0 + lead(0.5 * dt * exp(d) * f0, 1, 0) OVER w AS z0, 0.5 * dt * f1 + lead(0.5 * dt * exp(d) * f1, 1, 0) OVER w AS z1,
      f0 * p0 + f1 * p1 AS fb, f0 * u0 + f1 * u1 AS fu FROM i JOIN h USING (user_id, t) JOIN f USING (user_id, t) WINDOW w AS (PARTITION BY user_id ORDER BY t)),
k AS (SELECT *, CASE WHEN d > -60 AND d < 0 THEN (f0 * q0 + f1 * q1 + 0.5 * dt * fb) * exp(d) ELSE 0 END AS slope,
      sum(x * (z0 * b1 - z1 * b0) + g * (h0 * c1 - h1 * c0)) OVER (PARTITION BY user_id ORDER BY t DESC) AS later FROM j)
SELECT user_id, t, round(z0 * b0 + z1 * b1 + 0.25 * g, 4) + 0.0 AS gx, round(x * (z0 * co - z1 * si), 4) + 0.0 AS gb0, round(x * (z1 * co + z0 * si), 4) + 0.0 AS gb1,
       round(g * (h0 * co - h1 * si), 4) + 0.0 AS gc0, round(g * (h1 * co + h0 * si), 4) + 0.0 AS gc1, round(-0.1 * slope + 0.5 * exp(d) * fb + 0.5 * fu + 0.7 * later, 4) + 0.0 AS gdt,
       round(dt * (fu - exp(d) * fb), 4) + 0.0 AS glam, round(slope * dt, 4) + 0.0 AS grate, round(dt * later, 4) + 0.0 AS gtheta FROM k
""")
def grad_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradients of all inputs of the whole scan, turning and with a skip, over all events; output t counts 1 + t % 3."""
    df = event_sequences(spark, sf_dir)
    df = df.select(
        "user_id", "t", F.array("x").alias("x"), "dt", F.array(F.lit(1.0), F.pmod("event_id", F.lit(3)) / 3).alias("b"), F.array(F.lit(1.0), F.pmod("event_id", F.lit(5)) / 5).alias("c"),
        F.lit(LAMBDA).alias("lam"), F.lit(RATE).alias("rate"), F.lit(0.7).alias("theta"), F.array(1.0 + F.col("t") % 3).alias("g"),
    )
    found = packed.gradients(df, ["user_id"], "g", skip=0.25, theta="theta", chunk=16)
    r4 = lambda c, name: (F.round(c, 4) + 0.0).alias(name)
    arrays_ = [r4(F.col("gx")[0], "gx"), *[r4(F.col(c)[k], f"{c}{k}") for c in ("gb", "gc") for k in (0, 1)]]
    return found.select("user_id", "t", *arrays_, *[r4(F.col(c), c) for c in ("gdt", "glam", "grate", "gtheta")])


@query(f"""
SELECT i0, i1, round(v, 6) + 0.0 AS g, round(0.5 * v + CASE WHEN i1 > 0 THEN 0.5 * lag(v, 1, 0) OVER (PARTITION BY i0 ORDER BY i1) ELSE 0 END + 0.5 * v, 6) + 0.0 AS v
FROM {LONG}
""")
def grad_trapezoid_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient of dt, for the sum of x * (g + w) with lambda 1/2; g is what comes to w."""
    x = vector_tensor(spark, sf_dir)
    dt = autodiff.Var(x.map(lambda v: F.abs(v) + 0.1), "dt")
    with autodiff.written(settled):  # what several gradients read is a table, so that no task sorts many copies of it
        g, w = autodiff.trapezoid_weights(dt, autodiff.Var(TensorFrame.generated(spark, (1, 1), lambda *_: F.lit(0.5))), 1)
        loss = autodiff.sum_all(autodiff.mul(autodiff.add(g, w), autodiff.Var(x)))
        found = autodiff.backward(loss, retain={"w": w})
    of_w = elemwise.sided(found["w"].df.select("i0", "i1", r6("v").alias("g")), x.size)
    return found["dt"].df.select("i0", "i1", r6("v").alias("v")).join(of_w, ["i0", "i1"]).select("i0", "i1", "g", "v")


# Scans


def _turning(angle: str) -> str:
    return f"""
WITH a AS (SELECT user_id, t, s - round(s / 6.283185307179586) * 6.283185307179586 AS phi FROM
  (SELECT user_id, t, sum(dt * 0.7) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM {EVENTS})),
e AS (SELECT user_id, t, phi, x, greatest(-0.1 * dt, -60) AS d, dt, {angle} * cos(phi) AS p, {angle} * -sin(phi) AS q FROM {EVENTS} JOIN a USING (user_id, t)),
u AS (SELECT *, 0.5 * dt * p + 0.5 * dt * exp(d) * lag(p, 1, 0) OVER w AS up, 0.5 * dt * q + 0.5 * dt * exp(d) * lag(q, 1, 0) OVER w AS uq
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY t) AS a FROM u),
y AS (SELECT l.user_id, l.t, any_value(l.x) AS x, sum(exp(l.a - r.a) * r.up) * cos(any_value(l.phi)) + sum(exp(l.a - r.a) * r.uq) * -sin(any_value(l.phi)) AS y
  FROM s l JOIN s r ON l.user_id = r.user_id AND r.t <= l.t GROUP BY l.user_id, l.t)
"""


def _resumed(df: DataFrame, at: int, **how) -> DataFrame:
    """The scan of sequences that are cut before row at, and go on from the states there."""
    df = settled(df)
    first = settled(packed.scan(df.where(F.col("t") < at), ["user_id"], chunk=16, **how))
    rest = df.where(F.col("t") >= at).withColumn("t", F.col("t") - at)
    rest = packed.scan(rest, ["user_id"], chunk=16, state=sequence.final_states(first, ["user_id"]), **how)
    return first.select("user_id", "t", "y").unionByName(rest.select("user_id", (F.col("t") + at).alias("t"), "y"))


def _one_row(b: list[float], spark: SparkSession, sf_dir: str) -> DataFrame:
    df = event_sequences(spark, sf_dir).withColumns({"theta": F.lit(0.7), "lam": F.lit(LAMBDA), "rate": F.lit(RATE)})
    return df.withColumns({"b": F.array(*[F.lit(v) for v in b]), "c": F.array(*[F.lit(v) for v in b])})


@query(f"{_turning('x')} SELECT user_id, t, round(y + 0.25 * x, 5) + 0.0 AS y FROM y")
def ssm_rotational_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turning state with a skip, cut after five rows and resumed with its angle."""
    df = _one_row([1.0, 0.0], spark, sf_dir).withColumn("x", F.array("x"))
    return _resumed(df, 5, theta="theta", skip=0.25).select("user_id", "t", (F.round(F.col("y")[0], 5) + 0.0).alias("y"))


@query(f"{_turning('2 * x')} SELECT user_id, t, round(y + 0.25 * x, 5) + 0.0 AS y0, round(-y + 0.5 * x, 5) + 0.0 AS y1 FROM y")
def ssm_mimo_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inputs x and 2 x with B = (1, 0) and (1/2, 0), outputs by C = (1, 0) and (-1, 0), turning, with a skip, cut and resumed."""
    out = _resumed(_two_inputs(spark, sf_dir), 5, theta="theta", skip=0.25, rank=2)
    return out.select("user_id", "t", *[(F.round(F.col("y")[k][0], 5) + 0.0).alias(f"y{k}") for k in (0, 1)])


def _two_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _one_row([1.0, 0.0], spark, sf_dir)
    two = lambda a, b: F.array(F.array(*[F.lit(v) for v in a]), F.array(*[F.lit(v) for v in b]))
    return df.withColumns({"b": two([1.0, 0.0], [0.5, 0.0]), "c": two([1.0, 0.0], [-1.0, 0.0]), "x": F.array(F.array("x"), F.array(F.col("x") * 2))})


GROUPED = f"""
WITH f AS (SELECT user_id, t, [x / 100.0, (event_id % 7) / 7.0, (event_id % 5) / 5.0, 0.5] AS q, [x / 100.0, (event_id % 3) / 3.0] AS k, [x / 10.0, t / 10.0] AS v FROM {EVENTS}),
s AS (SELECT l.user_id, l.t, h, (list_dot_product(l.q[2 * h + 1 : 2 * h + 2], r.k)) * 0.5 AS z, r.v FROM f l JOIN f r ON l.user_id = r.user_id AND r.t <= l.t, range(2) u(h)),
m AS (SELECT *, exp(z - max(z) OVER (PARTITION BY user_id, t, h)) AS e FROM s),
o AS (SELECT user_id, t, h, round(sum(e * v[1]) / sum(e), 5) + 0.0 AS a, round(sum(e * v[2]) / sum(e), 5) + 0.0 AS b FROM m GROUP BY ALL)
SELECT x.user_id, x.t, x.a AS o0, x.b AS o1, y.a AS o2, y.b AS o3 FROM o x JOIN o y ON x.user_id = y.user_id AND x.t = y.t AND x.h = 0 AND y.h = 1
"""


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = event_sequences(spark, sf_dir)
    q = F.array(F.col("x") / 100, F.pmod("event_id", F.lit(7)) / 7, F.pmod("event_id", F.lit(5)) / 5, F.lit(0.5))
    return df.select("user_id", "t", q.alias("q"), F.array(F.col("x") / 100, F.pmod("event_id", F.lit(3)) / 3).alias("k"), F.array(F.col("x") / 10, F.col("t") / 10).alias("v"))


@query(GROUPED)
def attention_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two heads that share keys and values; rows from the fourth on read the first three as a cache."""
    df = settled(_grouped(spark, sf_dir))  # it is read many times, and numbering events takes several shuffles
    how = {"scale": 0.5, "heads": 2, "groups": 1, "chunk": 8}
    first, rest = df.where("t < 3"), df.where("t >= 3")
    both = sequence.attention(first, ["user_id"], "t", "q", "k", "v", **how).unionByName(sequence.attention(rest, ["user_id"], "t", "q", "k", "v", past=first, **how))
    return both.select("user_id", "t", *[(F.round(F.col("o")[i], 5) + 0.0).alias(f"o{i}") for i in range(4)])


@query(GROUPED)
def stream_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same attention on a stream that is stopped twice and goes on with its cache."""
    df = settled(_grouped(spark, sf_dir))
    parts = [df.where("t < 3"), df.where("t >= 3 AND t < 20"), df.where("t >= 20")]
    found = stateful.in_parts(parts, lambda s: stateful.attention(s, ["user_id"], "t", "q", "k", "v", 0.5, heads=2, groups=1))
    return found.select("user_id", "t", *[(F.round(F.col("o")[i], 5) + 0.0).alias(f"o{i}") for i in range(4)])


@query(f"{_turning('2 * x')} SELECT user_id, t, round(y + 0.25 * x, 5) + 0.0 AS y0, round(-y + 0.5 * x, 5) + 0.0 AS y1 FROM y")
def stream_handover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first twenty rows by a batch scan with turning, two inputs and outputs and a skip, the rest as a stream, stopped once."""
    df, how = settled(_two_inputs(spark, sf_dir)), {"theta": "theta", "skip": 0.25, "rank": 2}
    first = settled(sequence.scan(df.where("t < 20"), ["user_id"], **how))
    state = settled(stateful.last_states(first, ["user_id"]))
    parts = [df.where("t >= 20 AND t < 40"), df.where("t >= 40")]
    rest = stateful.in_parts(parts, lambda s: stateful.steps(s, ["user_id"], state=state, **how))
    out = first.select("user_id", "t", "y").unionByName(rest.select("user_id", "t", "y"))
    return out.select("user_id", "t", *[(F.round(F.col("y")[k][0], 5) + 0.0).alias(f"y{k}") for k in (0, 1)])


# Blocks


@query(f"""
WITH l AS {LONG}, c AS {CENTROIDS}, z AS (SELECT l.i0, c.c, sum(l.v * c.v) AS z FROM l JOIN c ON l.i1 = c.d GROUP BY ALL)
SELECT i0, d AS i1, round(sum(z / (1 + exp(-z)) * z * c.v), 5) + 0.0 AS v FROM z JOIN c USING (c) GROUP BY i0, d
""")
def gated_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gated feed-forward block whose matrices are the labels' mean vectors."""
    from .operators import movement

    x, down = vector_tensor(spark, sf_dir), centroids(spark, sf_dir)
    up = movement.transpose(down)
    return blocks.gated(x, up, up, down).df.select("i0", "i1", (F.round("v", 5) + 0.0).alias("v"))


@query(f"SELECT l.i0, l.i1, round(l.v + p.v, 6) + 0.0 AS v FROM {LONG} l JOIN (SELECT i0, i1, v FROM {LONG}) p ON l.i0 = p.i0 - 2 AND l.i1 = p.i1")
def positional_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To each vector the one two places on; the last two have none."""
    x = vector_tensor(spark, sf_dir)
    fitting = TensorFrame(x.df.where(F.col("i0") < x.shape[0] - 2), (x.shape[0] - 2, x.shape[1]))
    return cells(blocks.positional(fitting, x, start=2))


@query(f"""
WITH l AS {LONG}, c AS {CENTROIDS},
xs AS (SELECT max(abs(v)) / 127 AS s FROM l), ws AS (SELECT c, max(abs(v)) / 127 AS s FROM c GROUP BY c),
q AS (SELECT l.i0, c.c AS i1, sum(round(l.v / xs.s) * xs.s * round(c.v / ws.s) * ws.s) AS v FROM l JOIN c ON l.i1 = c.d JOIN ws ON ws.c = c.c, xs GROUP BY ALL)
SELECT i0, i1, round(v, 5) + 0.0 AS v FROM q
""")
def quantized_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors by the labels' means, the vectors at 8 bits for the whole table and the means at 8 bits a label."""
    from .operators import movement

    q = blocks.quantized_linear(vector_tensor(spark, sf_dir), movement.transpose(centroids(spark, sf_dir)))
    return q.df.select("i0", "i1", (F.round("v", 5) + 0.0).alias("v"))


# Generation


@query(f"""
WITH RECURSIVE c AS MATERIALIZED (SELECT list(x ORDER BY c) AS e FROM (SELECT c, list(v ORDER BY d) AS x FROM {CENTROIDS} GROUP BY c)),
p AS (SELECT conv_id AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, length(text) % 10 AS token FROM conversations WHERE text IS NOT NULL),
h AS (SELECT seq, max(pos) AS last FROM p GROUP BY seq),
s AS (SELECT p.seq, i, any_value(last) AS last, sum(pow(0.5, last - pos) * e[token + 1][i + 1]) AS v FROM p JOIN h USING (seq), c, range(64) r(i) GROUP BY p.seq, i),
g AS (
  SELECT seq, last AS pos, list(v ORDER BY i) AS h, CAST(NULL AS BIGINT) AS token, last FROM s GROUP BY seq, last
  UNION ALL
  SELECT seq, pos + 1, list_transform(range(64), lambda i: 0.5 * h[i + 1] + e[best + 1][i + 1]), best, last
  FROM (SELECT g.*, e, list_position(list_transform(e, lambda x: -list_dot_product(x, h)), list_max(list_transform(e, lambda x: -list_dot_product(x, h)))) - 1 AS best FROM g, c)
  WHERE pos < last + 6)
SELECT seq, pos, token FROM g WHERE token IS NOT NULL
""")
def generate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six tokens after each conversation, whose tokens are its turns' lengths modulo 10: greedily what is least like the state so far."""
    mean = np.array(centroids(spark, sf_dir).to_data()).reshape(10, -1)
    turns = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    prompts = sequence.positions(turns, ["conv_id"], ["turn"], "pos", parts=F.floor(F.col("turn") / 1000))
    prompts = prompts.select(F.col("conv_id").alias("seq"), "pos", (F.char_length("text") % 10).alias("token"))
    model = sampling.ScanModel(mean, -mean, 0.5)
    return sampling.generate_with_state(model.prefill(prompts), model.advance, sampling.Sampler(temperature=0), most=6)


# Training


def _steps_sql(n: int) -> str:
    """Steps of gradient descent on the mean squared error of a linear map to the label, written out."""
    ctes = [f"l AS MATERIALIZED {LONG}", "n AS (SELECT count(*) AS n FROM embeddings)", "w0 AS (SELECT d, 0.0 AS w FROM range(64) r(d))"]
    for k in range(n):
        ctes += [
            f"e{k} AS MATERIALIZED (SELECT i0, sum(v * w) - any_value(label) AS e FROM l JOIN w{k} ON i1 = d GROUP BY i0)",
            f"g{k} AS MATERIALIZED (SELECT i1 AS d, 2 * sum(v * e) / any_value(n) AS g FROM l JOIN e{k} USING (i0), n GROUP BY i1)",
            f"s{k} AS (SELECT (SELECT avg(e * e) FROM e{k}) AS loss, sqrt(sum(g * g)) AS norm FROM g{k})",
            f"w{k + 1} AS MATERIALIZED (SELECT d, w - 0.3 * least(1, 1 / (norm + 1e-6)) * g AS w FROM w{k} JOIN g{k} USING (d), s{k})",
        ]
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT {k + 1} AS step, round(loss, 6) AS loss, round(norm, 6) AS norm, round(least(1, 1 / (norm + 1e-6)), 6) AS factor FROM s{k}" for k in range(n))


@query(_steps_sql(4))
def train_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four steps of a linear map from vectors to labels, by gradients of the reverse-mode plan: what each step reports."""
    x = settled(vector_tensor(spark, sf_dir).df)
    shape = vector_tensor(spark, sf_dir).shape
    given = autodiff.Var(TensorFrame(x, shape))
    labels = autodiff.Var(TensorFrame.of(vectors(spark, sf_dir).withColumn("one", F.lit(0)), ["vec_id", "one"], "label", (shape[0], 1)))

    def loss(params: DataFrame) -> autodiff.Var:
        w = TensorFrame.of(params.withColumn("one", F.lit(0)), ["idx", "one"], "v", (shape[1], 1))
        return autodiff.mse(autodiff.matmul(given, autodiff.Var(w, "w")), labels)

    def gradients(params: DataFrame, _: DataFrame) -> DataFrame:
        return autodiff.backward(loss(params))["w"].df.select(F.lit("w").alias("param"), F.col("i0").alias("idx"), F.col("v").alias("g"))

    trainer = training.Trainer(training.Sgd(), gradients, lambda p, _: loss(p).tensor.df.select("v"), settled, training.Schedule(), learning_rate=0.3)
    params = training.parameters(spark.range(shape[1]).select(F.lit("w").alias("param"), F.col("id").alias("idx"), F.lit(0.0).alias("v")))
    trainer.fit(params, [x] * 4)
    return trainer.report.table(spark).select("step", *[F.round(c, 6).alias(c) for c in ("loss", "norm", "factor")])


# Permutations


def _permuted_sql(n: int, seed: int) -> str:
    """The rounds written out; numbers on spare cells are moved again."""
    p = Permutation(n, seed)
    a, b = p.sides

    def moved(of: str) -> str:
        out = f"SELECT i, v % {a} AS l, v // {a} AS r FROM ({of})"
        for k, (k0, k1, k2) in enumerate(p.keys):
            v, other, m = ("l", "r", b) if k % 2 else ("r", "l", a)
            out = f"SELECT i, l, r, ({v} % {PRIME} * {k0} + {k1}) % {PRIME} AS h FROM ({out})"
            out = f"SELECT i, {v}, ({other} + xor(h, h >> 15) % {PRIME} * {k2} % {PRIME}) % {m} AS {other} FROM ({out})"
        return f"SELECT i, l + r * {a} AS v FROM ({out})"

    return f"""WITH RECURSIVE w AS ({moved("SELECT event_id AS i, event_id AS v FROM events WHERE event_id < " + str(n))} UNION ALL {moved(f"SELECT i, v FROM w WHERE v >= {n}")})
SELECT event_id, v AS at, CASE WHEN v IS NOT NULL THEN event_id END AS back FROM events LEFT JOIN (SELECT i, v FROM w WHERE v < {n}) ON i = event_id"""


#: What the query permutes: numbers below this; event ids beyond it have no place.
PLACES = 9_973


@query(_permuted_sql(PLACES, 11))
def keyed_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each event in a shuffled order of the first 9,973 ids, and back."""
    p = Permutation(PLACES, 11)
    placed = read(spark, sf_dir, "events").select("event_id", p.forward(F.col("event_id")).alias("at"))
    return placed.select("event_id", "at", p.inverse(F.col("at")).alias("back"))


@query(f"""
WITH b AS (SELECT event_id % 3 AS k, min(value) AS low, max(value) AS high FROM events WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY k) AS i, count(*) OVER () AS n FROM b)
SELECT round(sum(low * CASE WHEN i = 1 THEN 1 ELSE 0.25 END * pow(0.75, n - i)), 6) AS low, round(sum(high * CASE WHEN i = 1 THEN 1 ELSE 0.25 END * pow(0.75, n - i)), 6) AS high, max(n) AS batches FROM r
""")
def stream_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moving range of events' values, a third of them in each of three runs of a stream."""
    events = read(spark, sf_dir, "events").select("event_id", "value")
    parts = [events.where(F.pmod("event_id", F.lit(3)) == k) for k in range(3)]
    found = ranges.observed_in_parts(parts, "value", 0.25)
    return found.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "batches")
