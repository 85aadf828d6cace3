"""Queries that apply each operator to the fixture tables, with their DuckDB twins. Floats are rounded to 6 places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frame import TensorFrame, arange, causal_mask, eye
from .functions import arrays, scalar
from .operators import contraction, elemwise, indexing, movement, packed, reduce, scan, sequence, tiles
from .plans import adapters, autodiff, sampling, training
from .sources import state
from .sources.tables import centroids, event_sequences, read, vector_tensor, vectors
from .streaming.recurrence import recurrence
from .streaming.run import settled, shared_path, to_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RATE, LAMBDA = -0.1, 0.5
KERNEL = [0.1, -0.2, 0.3, 0.5]

# Common parts of the SQL below.
X = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
LONG = f"(SELECT vec_id AS i0, label, generate_subscripts(x, 1) - 1 AS i1, unnest(x) AS v FROM {X})"
EVENTS = """(SELECT user_id, event_id, t, x, coalesce((us - lag(us) OVER (PARTITION BY user_id ORDER BY t)) / 3.6e9, 0) AS dt
  FROM (SELECT user_id, event_id, coalesce(value, 0) AS x, epoch_us(ts) AS us,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events))"""
CENTROIDS = f"(SELECT label AS c, i1 AS d, avg(v) AS v FROM {LONG} GROUP BY ALL)"
LOGITS = f"""(SELECT l.i0, l.label, list(s ORDER BY c) AS z FROM (
    SELECT a.i0, a.label, b.c, sum(a.v * b.v) AS s FROM {LONG} a JOIN {CENTROIDS} b ON a.i1 = b.d GROUP BY ALL) l GROUP BY ALL)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def r6(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x, 6) + F.lit(0.0)  # no negative zeros


def cells(t: TensorFrame, name: str = "v") -> DataFrame:
    return t.df.select(*t.axes, r6("v").alias(name))


def _named(parts: dict[str, TensorFrame]) -> DataFrame:
    out = None
    for name, t in parts.items():
        df = t.df.select(F.lit(name).alias("op"), *t.axes, r6("v").alias("v"))
        out = df if out is None else out.unionByName(df)
    return out


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i0, label, z): the products of each vector with the labels' mean vectors."""
    product = contraction.matmul_nt(vector_tensor(spark, sf_dir), centroids(spark, sf_dir))
    labels = vectors(spark, sf_dir).select(F.col("vec_id").alias("i0"), "label")
    return product.to_rows("z").join(labels, "i0")


# Elementwise functions


@query("""
SELECT l_orderkey, l_linenumber, round(exp(x), 6) AS exp, round(ln(q), 6) AS log, round(sqrt(q), 6) AS sqrt, round(1 / sqrt(q), 6) AS rsqrt,
       round(1 / q, 6) AS recip, round(abs(x), 6) AS abs, round(tanh(x), 6) AS tanh, round(sin(x), 6) AS sin, round(cos(x), 6) AS cos,
       floor(x) + 0.0 AS floor, round(x) + 0.0 AS round, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(greatest(x, 0), 6) AS relu,
       CAST(sign(x) AS DOUBLE) AS sign, round(-x, 6) + 0.0 AS neg
FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_quantity / 8 - 3.03 AS x FROM lineitem)
""")
def unary_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, q = F.col("x"), F.col("l_quantity")
    df = read(spark, sf_dir, "lineitem").withColumn("x", q / 8 - 3.03)
    of = {
        "exp": F.exp(x), "log": scalar.flog(q), "sqrt": F.sqrt(q), "rsqrt": scalar.rsqrt(q), "recip": scalar.recip(q), "abs": F.abs(x),
        "tanh": F.tanh(x), "sin": F.sin(x), "cos": F.cos(x), "floor": scalar.floor(x), "round": scalar.round_half_away(x),
        "sigmoid": scalar.sigmoid(x), "relu": scalar.relu(x), "sign": scalar.sign(x), "neg": -x,
    }
    return df.select("l_orderkey", "l_linenumber", *[r6(c).alias(k) for k, c in of.items()])


@query("""
SELECT l_orderkey, l_linenumber, round(x + 1.5, 6) AS add, round(x * -2, 6) + 0.0 AS mul, round(3 - x, 6) AS rsub, round(pow(q, 1.5), 6) AS pow,
       round(least(greatest(x, -1), 2), 6) AS clamp, CASE WHEN x > 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS gt, CASE WHEN x < 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS lt,
       CASE WHEN q = 10 THEN 1.0 ELSE 0.0 END::DOUBLE AS eq, round(x - round(x / 2.5) * 2.5, 6) + 0.0 AS wrap
FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_quantity / 8 - 3.03 AS x FROM lineitem)
""")
def scalar_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, q, n = F.col("x"), F.col("l_quantity"), scalar.number
    df = read(spark, sf_dir, "lineitem").withColumn("x", q / 8 - 3.03)
    of = {
        "add": x + 1.5, "mul": x * -2, "rsub": 3 - x, "pow": F.pow(q, F.lit(1.5)), "clamp": scalar.clamp(x, -1, 2), "gt": scalar.gt(x, n(1)),
        "lt": scalar.lt(x, n(1)), "eq": scalar.eq(q, n(10)), "wrap": scalar.wrap_to(x, 2.5),
    }
    return df.select("l_orderkey", "l_linenumber", *[r6(c).alias(k) for k, c in of.items()])


@query("""
SELECT l_orderkey, l_linenumber, round(x / (1 + exp(-x)), 6) + 0.0 AS silu, round(greatest(x, 0) + ln(1 + exp(-abs(x))), 6) AS softplus
FROM (SELECT l_orderkey, l_linenumber, l_quantity / 8 - 3.03 AS x FROM lineitem)
""")
def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").withColumn("x", F.col("l_quantity") / 8 - 3.03)
    return df.select("l_orderkey", "l_linenumber", r6(scalar.silu(F.col("x"))).alias("silu"), r6(scalar.softplus(F.col("x"))).alias("softplus"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity / 8 - 3.03 AS x FROM lineitem),
e AS (SELECT x, 2 / sqrt(pi()) * sum(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * pow(x / sqrt(2), 2 * k + 1) / (gamma(k + 1) * (2 * k + 1))) AS erf
  FROM (SELECT DISTINCT x FROM l), range(60) t(k) GROUP BY x)
SELECT l_orderkey, l_linenumber, round(x * 0.5 * (1 + erf), 6) + 0.0 AS gelu FROM l JOIN e USING (x)
""")
def gelu(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").withColumn("x", F.col("l_quantity") / 8 - 3.03)
    return df.select("l_orderkey", "l_linenumber", r6(scalar.gelu(F.col("x"))).alias("gelu"))


@query("""
SELECT l_orderkey, l_linenumber,
       round(x - scale * least(greatest(round(x / scale), -7), 7), 6) + 0.0 AS residual,
       round(exp(least(greatest(x - 1, -60), 0)) * 0.5, 6) AS decay
FROM (SELECT l_orderkey, l_linenumber, l_quantity / 8 - 3.03 AS x, 0.5 AS scale FROM lineitem)
""")
def decay_and_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem").withColumn("x", F.col("l_quantity") / 8 - 3.03)
    n, x = scalar.number, F.col("x")
    level = arrays.quantized(x, n(0.5), n(0), -7, 7)
    return df.select("l_orderkey", "l_linenumber", r6(x - level).alias("residual"), r6(scalar.exp_decay(x, n(1), n(0.5))).alias("decay"))


# Broadcasting and reductions


@query(f"""
WITH l AS {LONG}, r AS (SELECT i0, avg(v) AS m FROM l GROUP BY i0), c AS (SELECT i1, avg(v) AS m FROM l GROUP BY i1)
SELECT 'add' AS op, i0, i1, round(v + r.m, 6) + 0.0 AS v FROM l JOIN r USING (i0)
UNION ALL SELECT 'mul', i0, i1, round(v * c.m, 6) + 0.0 FROM l JOIN c USING (i1)
UNION ALL SELECT 'maximum', i0, i1, round(greatest(v, c.m), 6) + 0.0 FROM l JOIN c USING (i1)
UNION ALL SELECT 'greater', i0, i1, CASE WHEN v > r.m THEN 1.0 ELSE 0.0 END FROM l JOIN r USING (i0)
UNION ALL SELECT 'outer', i0, i1, round(r.m - c.m, 6) + 0.0 FROM r, c
""")
def broadcast_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vector_tensor(spark, sf_dir)
    rows, columns = reduce.mean_dim(x, 1), reduce.mean_dim(x, 0)
    parts = {"add": elemwise.add(x, rows), "mul": elemwise.mul(x, columns), "maximum": elemwise.maximum(x, columns)}
    parts |= {"greater": elemwise.greater(x, rows), "outer": elemwise.sub(rows, columns)}
    return _named(parts)


@query(f"""
SELECT i0, round(sum(v), 6) + 0.0 AS sum, round(max(v), 6) + 0.0 AS max, round(min(v), 6) + 0.0 AS min, round(avg(v), 6) + 0.0 AS mean FROM {LONG} GROUP BY i0
""")
def reduce_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, out = vector_tensor(spark, sf_dir), None
    for name, f in (("sum", reduce.sum_dim), ("max", reduce.max_dim), ("min", reduce.min_dim), ("mean", reduce.mean_dim)):
        df = f(x, 1).df.select("i0", r6("v").alias(name))
        out = df if out is None else out.join(df, "i0")
    return out


@query("SELECT l_orderkey, round(product(1 - l_discount), 6) AS kept FROM lineitem GROUP BY l_orderkey")
def reduce_prod(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    orders, numbers = lines.agg(F.max("l_orderkey") + 1, F.max("l_linenumber") + 1).first()
    kept = TensorFrame.of(lines, ["l_orderkey", "l_linenumber"], 1 - F.col("l_discount"), (orders, numbers))  # of a sparse one: what is not there is 1
    return reduce.prod_dim(kept, 1).df.select(F.col("i0").alias("l_orderkey"), r6("v").alias("kept"))


@query(f"SELECT round(sum(v), 4) AS total, round(avg(v), 6) AS mean, round(sum(v * v), 4) AS squares FROM {LONG}")
def reduce_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vector_tensor(spark, sf_dir)
    total, mean, squares = (f(x).df.select(F.col("v").alias(n)) for n, f in (("total", reduce.sum_all), ("mean", reduce.mean_all), ("squares", reduce.sum_squares)))
    one = total.crossJoin(mean).crossJoin(squares)  # one row each
    return one.select(F.round("total", 4).alias("total"), r6("mean").alias("mean"), F.round("squares", 4).alias("squares"))


@query(f"SELECT vec_id AS i0, CAST(list_position(x, list_max(x)) - 1 AS DOUBLE) AS best FROM {X}")
def argmax_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.argmax(vector_tensor(spark, sf_dir), 1).df.select("i0", F.col("v").alias("best"))


@query(f"SELECT vec_id, list_position(x, list_max(x)) - 1 AS best FROM {X}")
def argmax_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", arrays.argmax(F.col("x")).alias("best"))


# Scans, shifts, movement


@query(f"""
SELECT i0, i1, round(sum(v) OVER (w ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS cumsum,
       round(coalesce(sum(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) + 0.0 AS exclusive,
       round(sum(v) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS reverse,
       round(coalesce(sum(v) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), 6) + 0.0 AS reverse_exclusive
FROM {LONG} WINDOW w AS (PARTITION BY i0 ORDER BY i1)
""")
def cumsum4(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, out = vector_tensor(spark, sf_dir), None
    for name, f in (("cumsum", scan.cumsum), ("exclusive", scan.cumsum_exclusive), ("reverse", scan.cumsum_reverse), ("reverse_exclusive", scan.cumsum_reverse_exclusive)):
        df = f(x, 1).df.select("i0", "i1", r6("v").alias(name))
        out = df if out is None else out.join(df, ["i0", "i1"])
    return out


@query(f"""
SELECT i0, i1, round(lag(v, 1, 0) OVER w, 6) + 0.0 AS right, round(lag(v, 3, 0) OVER w, 6) + 0.0 AS by3, round(lead(v, 1, 0) OVER w, 6) + 0.0 AS left
FROM {LONG} WINDOW w AS (PARTITION BY i0 ORDER BY i1)
""")
def shift_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, out = vector_tensor(spark, sf_dir), None
    for name, t in (("right", scan.shift_right(x, 1)), ("by3", scan.shift_by(x, 1, 3)), ("left", scan.shift_left(x, 1))):
        df = t.df.select("i0", "i1", r6("v").alias(name))
        out = df if out is None else out.join(df, ["i0", "i1"])
    return out


@query(f"SELECT (63 - i1) - 8 AS i0, i0 AS i1, round(v, 6) + 0.0 AS v FROM {LONG} WHERE 63 - i1 BETWEEN 8 AND 23")
def permute_flip_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(movement.narrow(movement.flip(movement.transpose(vector_tensor(spark, sf_dir)), 0), 0, 8, 16))


@query(f"""
SELECT i0, CASE WHEN i1 < 16 THEN i1 + 48 ELSE i1 - 16 END AS i1, round(v, 6) + 0.0 AS v FROM {LONG}
""")
def cat_split_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, *rest = movement.chunk(vector_tensor(spark, sf_dir), 4, 1)
    return cells(movement.cat([*rest, first], 1))


@query(f"""
SELECT CASE WHEN i1 < 16 OR i1 BETWEEN 40 AND 47 THEN n - 1 - i0 ELSE i0 END AS i0, i1, round(v, 6) + 0.0 AS v
FROM {LONG}, (SELECT max(vec_id) + 1 AS n FROM embeddings)
""")
def reverse_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(movement.reverse_bands(vector_tensor(spark, sf_dir), 0, [(0, 16), (40, 48)]))


@query(f"""
SELECT i0, (y // 4) * 2 + x // 4 AS i1, (y % 4) * 4 + x % 4 AS i2, round(v, 6) + 0.0 AS v FROM (SELECT i0, i1 // 8 AS y, i1 % 8 AS x, v FROM {LONG})
""")
def patch_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vector_tensor(spark, sf_dir)
    return cells(movement.patches(movement.reshape(x, (x.shape[0], 1, 8, 8)), 4))


@query(f"""
WITH e AS {EVENTS}
SELECT user_id, t, round(sum(x) OVER w, 6) + 0.0 AS causal, round(sum(x) OVER w - x, 6) + 0.0 AS strict FROM e
WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)
""")
def masked_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both causal masks, as long as the longest sequence, over all events: what each row sees, and what it sees but for itself."""
    df = settled(event_sequences(spark, sf_dir))
    n = df.agg(F.max("t")).first()[0] + 1
    seen = df.select("user_id", F.col("t").alias("i1"), "x")
    out = df.select("user_id", "t")
    for name, strict in (("causal", False), ("strict", True)):
        mask = causal_mask(spark, n, strict=strict).df
        sums = mask.where("v != 0").join(seen, "i1").groupBy("user_id", F.col("i0").alias("t")).agg(F.sum(F.col("v") * F.col("x")).alias(name))
        out = out.join(sums, ["user_id", "t"], "left").withColumn(name, r6(F.coalesce(name, F.lit(0.0))))
    return out


@query(f"SELECT i0, i1, round(v + i1, 6) + 0.0 AS v FROM {LONG}")
def constructors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors by the unit matrix, plus the numbers of their places."""
    x = vector_tensor(spark, sf_dir)
    same = contraction.matmul(x, eye(spark, x.shape[1]))
    return cells(elemwise.add(same, movement.unsqueeze(arange(spark, x.shape[1]), 0)))


# Lookups and contractions


@query(f"""
SELECT doc_id, i1, round(v, 6) + 0.0 AS v FROM labels JOIN (SELECT i0, i1, v, n FROM {LONG}, (SELECT max(vec_id) + 1 AS n FROM embeddings)) ON doc_id % n = i0
""")
def gather_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vector_tensor(spark, sf_dir)
    ids = read(spark, sf_dir, "labels").select("doc_id", F.pmod("doc_id", F.lit(x.shape[0])).alias("id"))
    return indexing.gather_rows(x, ids).select("doc_id", "i1", r6("v").alias("v"))


@query(f"""
SELECT r AS i0, d AS i1, round(coalesce(s, 0), 6) + 0.0 AS v FROM range(12) a(r), range(64) b(d)
LEFT JOIN (SELECT label, i1, sum(v) AS s FROM {LONG} GROUP BY ALL) ON label = r AND i1 = d
""")
def scatter_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = vectors(spark, sf_dir).select(F.col("label").cast("bigint").alias("id"), F.posexplode("x").alias("i1", "v"))
    return cells(indexing.scatter_add_rows(spread.withColumn("i1", F.col("i1").cast("bigint")), 12, 64))


@query("SELECT vec_id AS i0, c AS i1, CASE WHEN c = label THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM embeddings, range(8) t(c)")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    n = rows.agg(F.max("vec_id")).first()[0] + 1
    return cells(indexing.one_hot(TensorFrame.of(rows, ["vec_id"], "label", (n,)), 8))


@query(f"SELECT i0, round(v, 6) + 0.0 AS v FROM {LONG} WHERE i1 = label")
def take_along_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vector_tensor(spark, sf_dir)
    return cells(indexing.take_along_last(x, TensorFrame.of(vectors(spark, sf_dir), ["vec_id"], "label", x.shape[:1])))


@query(f"SELECT a.i1 AS i0, b.i1, round(sum(a.v * b.v), 6) + 0.0 AS v FROM {LONG} a JOIN {LONG} b USING (i0) GROUP BY ALL")
def matmul_tn_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By tiles that are cut from the vectors' arrays."""
    rows, shape = vectors(spark, sf_dir), vector_tensor(spark, sf_dir).shape
    x = tiles.Tiles.of_rows(rows, "vec_id", "x", shape)
    return cells(tiles.matmul(x, x, transpose_a=True).frame())


@query(f"SELECT a.i1 AS i0, b.i1, round(sum(a.v * tanh(b.v)), 6) + 0.0 AS v FROM {LONG} a JOIN {LONG} b USING (i0) GROUP BY ALL")
def weight_grad_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient of a matrix that follows the vectors, for gradients tanh(v) of what it gives, from tensor relations."""
    x = vector_tensor(spark, sf_dir)
    return cells(tiles.weight_gradient(x, x.map(F.tanh), side=32))


@query(f"SELECT i0, c AS i1, round(sum(a.v * b.v), 6) + 0.0 AS v FROM {LONG} a JOIN {CENTROIDS} b ON a.i1 = b.d GROUP BY ALL")
def matmul_centroid_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(contraction.matmul_nt(vector_tensor(spark, sf_dir), centroids(spark, sf_dir)))


@query(f"SELECT i0, c AS i1, round(sum(a.v * b.v), 6) + 0.0 AS v FROM {LONG} a JOIN {CENTROIDS} b ON a.i1 = b.d GROUP BY ALL")
def matmul_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(contraction.matmul_nt(vector_tensor(spark, sf_dir), centroids(spark, sf_dir), strategy="shuffle"))


# Rows: softmax, norms, losses


@query(f"""
WITH l AS {LOGITS}, e AS (SELECT i0, list_max(z) AS top, list_sum(list_transform(z, lambda u: exp(u - list_max(z)))) AS s, z FROM l)
SELECT i0, list_transform(z, lambda u: round(exp(u - top) / s, 6)) AS p, list_transform(z, lambda u: round(u - top - ln(s), 6)) AS log_p FROM e
""")
def softmax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("z")
    return logits(spark, sf_dir).select("i0", F.transform(arrays.softmax(z), r6).alias("p"), F.transform(arrays.log_softmax(z), r6).alias("log_p"))


@query(f"""
WITH l AS {LOGITS}, e AS (SELECT i0, label, z, list_max(z) + ln(list_sum(list_transform(z, lambda u: exp(u - list_max(z))))) AS lse FROM l)
SELECT i0, round(lse - z[label + 1], 6) + 0.0 AS loss, round(lse - 0.9 * z[label + 1] - 0.1 * list_avg(z), 6) + 0.0 AS smoothed FROM e
""")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, y = F.col("z"), F.col("label")
    return logits(spark, sf_dir).select("i0", r6(arrays.cross_entropy(z, y)).alias("loss"), r6(arrays.cross_entropy(z, y, 0.1)).alias("smoothed"))


@query(f"""
WITH l AS {LOGITS}, e AS (SELECT label, z, list_max(z) + ln(list_sum(list_transform(z, lambda u: exp(u - list_max(z))))) AS lse FROM l WHERE label != 3)
SELECT round(avg(lse - z[label + 1]), 6) AS loss, round(exp(avg(lse - z[label + 1])), 6) AS perplexity,
       round(avg(CASE WHEN list_position(z, list_max(z)) - 1 = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM e
""")
def accuracy_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training.mean_cross_entropy(logits(spark, sf_dir), "z", "label", ignore=3)
    return out.select(r6("loss").alias("loss"), r6("perplexity").alias("perplexity"), r6("accuracy").alias("accuracy"), "n")


@query(f"""
WITH s AS (SELECT vec_id, x, list_avg(x) AS m, list_sum(list_transform(x, lambda u: u * u)) / len(x) AS ms FROM {X}),
t AS (SELECT *, list_sum(list_transform(x, lambda u: (u - m) * (u - m))) / len(x) AS var FROM s)
SELECT vec_id, list_transform(x, lambda u: round(u / sqrt(ms + 1e-5), 6) + 0.0) AS rms, list_transform(x, lambda u: round((u - m) / sqrt(var + 1e-5), 6) + 0.0) AS layer FROM t
""")
def norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return vectors(spark, sf_dir).select("vec_id", F.transform(arrays.rms_norm(x), r6).alias("rms"), F.transform(arrays.layer_norm(x), r6).alias("layer"))


@query(f"""
WITH s AS (SELECT vec_id, x, 1 / sqrt(list_sum(list_transform(x, lambda u: u * u)) / 64 + 1e-5) AS r, list_sum(x) AS dot FROM {X})
SELECT vec_id, list_transform(x, lambda u: round(r - u * dot * r * r * r / 64, 6) + 0.0) AS dx, list_transform(x, lambda u: round(u * r, 6) + 0.0) AS dw FROM s
""")
def rms_norm_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.transform("x", lambda _: scalar.number(1))
    dx, dw = arrays.rms_norm_backward(F.col("x"), one, one)
    return vectors(spark, sf_dir).select("vec_id", F.transform(dx, r6).alias("dx"), F.transform(dw, r6).alias("dw"))


@query(f"""
WITH s AS (SELECT vec_id, x, list_transform(range(32), lambda k: (vec_id % 64) * pow(10000.0, -2.0 * k / 64)) AS a FROM {X})
SELECT vec_id, list_transform(range(64), lambda k: round(CASE WHEN k < 32 THEN x[k + 1] * cos(a[k + 1]) - x[k + 33] * sin(a[k + 1])
       ELSE x[k - 31] * sin(a[k - 31]) + x[k + 1] * cos(a[k - 31]) END, 6) + 0.0) AS y FROM s
""")
def rope(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = arrays.rotary(F.col("x"), F.pmod("vec_id", F.lit(64)), 64)
    return vectors(spark, sf_dir).select("vec_id", F.transform(y, r6).alias("y"))


# Sequences


@query(f"""
SELECT user_id, t, round(0.5 * x + 0.3 * lag(x, 1, 0) OVER w - 0.2 * lag(x, 2, 0) OVER w + 0.1 * lag(x, 3, 0) OVER w, 6) + 0.0 AS y
FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY t)
""")
def causal_conv1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sequence.causal_conv(event_sequences(spark, sf_dir), ["user_id"], "t", "x", KERNEL)
    return df.select("user_id", "t", r6("y").alias("y"))


@query(f"""
SELECT user_id, t, round(0.5 * dt, 6) AS g, round(0.5 * dt + lead(0.5 * dt, 1, 0) OVER w, 6) AS w
FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY t)
""")
def trapezoid_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = event_sequences(spark, sf_dir).withColumn("lam", F.lit(LAMBDA))
    return sequence.trapezoid_weights(df, ["user_id"]).select("user_id", "t", r6("g").alias("g"), r6("w").alias("w"))


@query(f"""
WITH e AS (SELECT user_id, t, t // 8 AS k, -0.1 * dt AS d, 0.5 * dt AS g, 0.5 * dt + lead(0.5 * dt, 1, 0) OVER (PARTITION BY user_id ORDER BY t) AS w FROM {EVENTS}),
s AS (SELECT *, sum(d) OVER (PARTITION BY user_id, k ORDER BY t) AS a FROM e)
SELECT l.user_id, l.k, l.t, r.t AS s, round(CASE WHEN l.t = r.t THEN r.g ELSE r.w END * exp(greatest(l.a - r.a, -60)), 6) AS weight
FROM s l JOIN s r ON l.user_id = r.user_id AND l.k = r.k AND r.t <= l.t
""")
def ssd_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = event_sequences(spark, sf_dir).withColumns({"lam": F.lit(LAMBDA), "log_decay": F.col("dt") * RATE})
    df = sequence.band(sequence.trapezoid_weights(df, ["user_id"]), ["user_id"], 8)
    return df.select("user_id", "k", "t", "s", r6("weight").alias("weight"))


SCAN = f"""
WITH e AS (SELECT user_id, t, greatest(-0.1 * dt, -60) AS d, 0.5 * dt * x + 0.5 * dt * exp(greatest(-0.1 * dt, -60)) * lag(x, 1, 0) OVER (PARTITION BY user_id ORDER BY t) AS u FROM {EVENTS}),
s AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY t) AS a FROM e)
SELECT l.user_id, l.t, round(sum(exp(l.a - r.a) * r.u), 6) + 0.0 AS h FROM s l JOIN s r ON l.user_id = r.user_id AND r.t <= l.t GROUP BY ALL
"""


def _scalar_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.array(F.lit(1.0))
    df = event_sequences(spark, sf_dir)
    return df.withColumns({"x": F.array("x"), "b": one, "c": one, "lam": F.lit(LAMBDA), "rate": F.lit(RATE)})


@query(SCAN)
def ssm_scan_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's recurrence over the hours between events, by a band join: for short sequences."""
    df = event_sequences(spark, sf_dir)
    log_decay, decay, before, now = sequence.coefficients(F.col("dt"), F.lit(RATE), F.lit(LAMBDA))
    df = sequence.with_previous(df, ["user_id"], "t", {"last": "x"})
    df = df.select("user_id", "t", log_decay.alias("d"), (now * F.col("x") + before * F.coalesce("last", F.lit(0.0))).alias("u"))
    return sequence.scan_band(df, ["user_id"], "t", "d", "u").select("user_id", "t", r6("h").alias("h"))


@query(SCAN)
def ssm_scan_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: each user's recurrence over the hours between events, in chunks."""
    df = packed.scan(_scalar_scan(spark, sf_dir), ["user_id"], chunk=16)
    return df.select("user_id", "t", r6(F.col("h")[0]).alias("h"))


@query(SCAN)
def ssm_scan_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long chunks, of which most users fill one."""
    df = sequence.scan(_scalar_scan(spark, sf_dir), ["user_id"], chunk=1024)
    return df.select("user_id", "t", r6(F.col("h")[0]).alias("h"))


@query(SCAN)
def ssm_split_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences cut after their fifth row; the second parts go on from the states of the first."""
    df = _scalar_scan(spark, sf_dir)
    first = sequence.scan(df.where("t < 5"), ["user_id"])
    rest = df.where("t >= 5").withColumn("t", F.col("t") - 5)
    rest = sequence.scan(rest, ["user_id"], state=sequence.final_states(first, ["user_id"]))
    both = first.select("user_id", "t", "h").unionByName(rest.select("user_id", (F.col("t") + 5).alias("t"), "h"))
    return both.select("user_id", "t", r6(F.col("h")[0]).alias("h"))


@query(f"SELECT user_id, t, round(2 * h, 5) + 0.0 AS y0, round(-2 * h, 5) + 0.0 AS y1 FROM ({SCAN.replace('round(sum(exp(l.a - r.a) * r.u), 6) + 0.0', 'sum(exp(l.a - r.a) * r.u)')})")
def ssm_mimo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inputs x and 2 x with B = 1 and 1/2, two outputs with C = 1 and -1."""
    pair = lambda a, b: F.array(F.array(a), F.array(b))
    df = event_sequences(spark, sf_dir).withColumns({"lam": F.lit(LAMBDA), "rate": F.lit(RATE)})
    df = df.withColumns({"b": pair(F.lit(1.0), F.lit(0.5)), "c": pair(F.lit(1.0), F.lit(-1.0)), "x": pair(F.col("x"), F.col("x") * 2)})
    out = packed.scan(df, ["user_id"], rank=2, chunk=32)
    y = lambda k: (F.round(F.col("y")[k][0], 5) + 0.0).alias(f"y{k}")
    return out.select("user_id", "t", y(0), y(1))


@query(f"""
WITH e AS (SELECT user_id, t, sum(dt * 0.7) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM {EVENTS})
SELECT user_id, t, round(s - round(s / 6.283185307179586) * 6.283185307179586, 5) + 0.0 AS phi FROM e
""")
def ssm_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = event_sequences(spark, sf_dir).withColumn("theta", F.lit(0.7))
    return sequence.wrapped_angle(df, ["user_id"]).select("user_id", "t", (F.round("phi", 5) + 0.0).alias("phi"))


@query(f"""
WITH a AS (SELECT user_id, t, s - round(s / 6.283185307179586) * 6.283185307179586 AS phi FROM
  (SELECT user_id, t, sum(dt * 0.7) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM {EVENTS})),
e AS (SELECT user_id, t, phi, greatest(-0.1 * dt, -60) AS d, dt, x * cos(phi) AS p, x * -sin(phi) AS q FROM {EVENTS} JOIN a USING (user_id, t)),
u AS (SELECT *, 0.5 * dt * p + 0.5 * dt * exp(d) * lag(p, 1, 0) OVER w AS up, 0.5 * dt * q + 0.5 * dt * exp(d) * lag(q, 1, 0) OVER w AS uq
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY t) AS a FROM u)
SELECT l.user_id, l.t, round(sum(exp(l.a - r.a) * r.up) * cos(any_value(l.phi)) + sum(exp(l.a - r.a) * r.uq) * -sin(any_value(l.phi)), 5) + 0.0 AS y
FROM s l JOIN s r ON l.user_id = r.user_id AND r.t <= l.t GROUP BY l.user_id, l.t
""")
def ssm_rotational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of two values; B = C = (1, 0) turned back by the angle of each row."""
    one = F.array(F.lit(1.0), F.lit(0.0))
    df = event_sequences(spark, sf_dir).withColumns({"x": F.array("x"), "b": one, "c": one, "lam": F.lit(LAMBDA), "rate": F.lit(RATE), "theta": F.lit(0.7)})
    return packed.scan(df, ["user_id"], theta="theta", chunk=32).select("user_id", "t", (F.round(F.col("y")[0], 5) + 0.0).alias("y"))


@query(f"""
WITH f AS ({SCAN.replace("round(sum(exp(l.a - r.a) * r.u), 6) + 0.0", "sum(exp(l.a - r.a) * r.u)")}),
n AS (SELECT user_id, max(t) AS last FROM {EVENTS} GROUP BY ALL),
b AS ({SCAN.replace("round(sum(exp(l.a - r.a) * r.u), 6) + 0.0", "sum(exp(l.a - r.a) * r.u)").replace(EVENTS, f"(SELECT user_id, last - t AS t, x, dt FROM {EVENTS} JOIN (SELECT user_id, max(t) AS last FROM {EVENTS} GROUP BY ALL) USING (user_id))")})
SELECT f.user_id, f.t, round(f.h + b.h, 6) + 0.0 AS h FROM f JOIN n USING (user_id) JOIN b ON b.user_id = f.user_id AND b.t = last - f.t
""")
def bidirectional_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = settled(_scalar_scan(spark, sf_dir))
    last = df.groupBy("user_id").agg(F.max("t").alias("last"))
    back = packed.scan(df.join(last, "user_id").withColumn("t", F.col("last") - F.col("t")), ["user_id"], chunk=32).join(last, "user_id")
    back = back.select("user_id", (F.col("last") - F.col("t")).alias("t"), F.col("h")[0].alias("back"))
    both = packed.scan(df, ["user_id"], chunk=32).join(back, ["user_id", "t"])
    return both.select("user_id", "t", r6(F.col("h")[0] + F.col("back")).alias("h"))


@query(f"""
WITH h AS ({SCAN}), e AS (SELECT *, lag(x, 1, 0) OVER w AS x1, lag(x, 2, 0) OVER w AS x2, lag(x, 3, 0) OVER w AS x3 FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, event_id, t, h, round({KERNEL[0]} * x3 + {KERNEL[1]} * x2 + {KERNEL[2]} * x1 + {KERNEL[3]} * x, 6) + 0.0 AS y, false AS late FROM e JOIN h USING (user_id, t)
""")
def stream_ssm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recurrence and the convolution as a stream over the events' files, run until all is read."""
    schema = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    found = to_table(recurrence(stream, RATE, LAMBDA, KERNEL))
    return found.select("user_id", "event_id", "t", r6("h").alias("h"), r6("y").alias("y"), "late")


@query("""
WITH f AS (SELECT conv_id, turn AS t, length(text) / 100.0 AS a, (turn % 7) / 7.0 AS b FROM conversations WHERE text IS NOT NULL),
s AS (SELECT l.conv_id, l.t, (l.a * r.a + l.b * r.b) * 0.5 AS z, r.a, r.b FROM f l JOIN f r ON l.conv_id = r.conv_id AND r.t <= l.t),
m AS (SELECT *, exp(z - max(z) OVER (PARTITION BY conv_id, t)) AS e FROM s)
SELECT conv_id, t, round(sum(e * a) / sum(e), 6) AS o0, round(sum(e * b) / sum(e), 6) AS o1 FROM m GROUP BY ALL
""")
def attention_causal(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    f = F.array(F.char_length("text") / 100.0, F.pmod("turn", F.lit(7)) / 7.0)
    rows = turns.select("conv_id", F.col("turn").alias("t"), f.alias("f"))
    out = sequence.attention(rows, ["conv_id"], "t", "f", "f", "f", 0.5)
    return out.select("conv_id", "t", r6(F.col("o")[0]).alias("o0"), r6(F.col("o")[1]).alias("o1"))


# Quantization, adapters, training


def _levels(scale: str, zero: str, low: int, high: int) -> str:
    return f"round((least(greatest(round(v / {scale} + {zero}), {low}), {high}) - {zero}) * {scale}, 5) + 0.0"


@query(f"SELECT i0, i1, {_levels('s', '0', -127, 127)} AS v FROM {LONG}, (SELECT greatest(max(abs(v)), 1e-12) / 127 AS s FROM {LONG})")
def quant_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.quantize(vector_tensor(spark, sf_dir)).df.select("i0", "i1", (F.round("v", 5) + 0.0).alias("v"))


@query(f"SELECT i0, i1, {_levels('s', '0', -7, 7)} AS v FROM {LONG} JOIN (SELECT i1, greatest(max(abs(v)), 1e-12) / 7 AS s FROM {LONG} GROUP BY i1) USING (i1)")
def quant_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.quantize(vector_tensor(spark, sf_dir), bits=4, axis=1).df.select("i0", "i1", (F.round("v", 5) + 0.0).alias("v"))


@query(f"""
SELECT i0, i1, {_levels('s', 'z', 0, 255)} AS v FROM {LONG}, (SELECT s, round(-lo / s) AS z FROM (
  SELECT least(min(v), 0) AS lo, greatest(greatest(max(v), 0) - least(min(v), 0), 1e-12) / 255 AS s FROM {LONG}))
""")
def quant_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.quantize(vector_tensor(spark, sf_dir), symmetric=False).df.select("i0", "i1", (F.round("v", 5) + 0.0).alias("v"))


@query(f"""
WITH a AS (SELECT r AS i, c AS j, ((r * 7 + c * 3) % 11) / 11.0 - 0.5 AS v FROM range(64) x(r), range(4) y(c)),
b AS (SELECT r AS i, c AS j, ((r * 5 + c) % 7) / 7.0 - 0.4 AS v FROM range(4) x(r), range(8) y(c)),
h AS (SELECT i0, j, sum(l.v * a.v) AS v FROM {LONG} l JOIN a ON i1 = i GROUP BY ALL)
SELECT i0, b.j AS i1, round(sum(h.v * b.v) * 2, 6) + 0.0 AS v FROM h JOIN b ON h.j = b.i GROUP BY ALL
""")
def lora_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = TensorFrame.generated(spark, (64, 4), lambda r, c: F.pmod(r * 7 + c * 3, F.lit(11)) / 11.0 - 0.5)
    b = TensorFrame.generated(spark, (4, 8), lambda r, c: F.pmod(r * 5 + c, F.lit(7)) / 7.0 - 0.4)
    return cells(adapters.lora_delta(vector_tensor(spark, sf_dir), a, b, 8.0))


@query("""
WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) / 1e6 AS p FROM lineitem GROUP BY ALL)
SELECT round(avg((p - o_totalprice / 1e6) * (p - o_totalprice / 1e6)), 6) AS mse, round(avg(abs(p - o_totalprice / 1e6)), 6) AS mae FROM l JOIN orders ON l_orderkey = o_orderkey
""")
def mse_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1e6
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(paid.alias("p"))
    both = lines.join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    total = F.col("o_totalprice") / 1e6
    return both.agg(F.round(training.mse(F.col("p"), total), 6).alias("mse"), F.round(training.mae(F.col("p"), total), 6).alias("mae"))


def _params(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    spread = vectors(spark, sf_dir).select(F.concat(F.lit("row"), F.col("vec_id")).alias("param"), F.posexplode("x").alias("idx", "v"))
    return training.parameters(spread), spread.select("param", "idx", (F.col("v") * 0.5 - 0.01).alias("g"))


PARAMS = f"(SELECT 'row' || i0 AS param, i1 AS idx, v, v * 0.5 - 0.01 AS g FROM {LONG})"


@query(f"""
SELECT param, idx, round(v - 0.001 * (0.1 * g / (1 - 0.9) / (sqrt(0.05 * g * g / (1 - 0.95)) + 1e-8) + 0.1 * v), 6) + 0.0 AS v,
       round(0.1 * g, 6) + 0.0 AS m, round(0.05 * g * g, 6) + 0.0 AS s FROM {PARAMS}
""")
def adamw_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training.AdamW().step(*_params(spark, sf_dir), 1)
    return out.select("param", F.col("idx").cast("bigint").alias("idx"), *[r6(c).alias(c) for c in ("v", "m", "s")])


@query(f"SELECT param, idx, round(v - 0.01 * ((g + 0.1 * v) + 0.9 * (g + 0.1 * v)), 6) + 0.0 AS v, round(g + 0.1 * v, 6) + 0.0 AS m FROM {PARAMS}")
def sgd_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training.Sgd(momentum=0.9, nesterov=True, decay=0.1).step(*_params(spark, sf_dir), 1)
    return out.select("param", F.col("idx").cast("bigint").alias("idx"), r6("v").alias("v"), r6("m").alias("m"))


@query(f"SELECT round(n, 6) AS norm, round(least(1, 1 / (n + 1e-6)), 6) AS factor FROM (SELECT sqrt(sum(g * g)) AS n FROM {PARAMS})")
def grad_norm_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = training.gradient_norm(_params(spark, sf_dir)[1])
    return norm.select(r6("norm").alias("norm"), r6(training.clip_factor(F.col("norm"), 1.0)).alias("factor"))


@query("""
WITH o AS (SELECT o_orderkey, CAST(floor((epoch_us(o_orderdate) - min(epoch_us(o_orderdate)) OVER ()) / 8.64e10) AS BIGINT) + 1 AS r FROM orders),
s AS (SELECT o_orderkey, r AS step, least(greatest((r - 10) / 190.0, 0), 1) AS d FROM o)
SELECT o_orderkey, step, CAST(0.001 AS DOUBLE) AS constant, round(CASE WHEN step < 10 THEN 0.001 * step / 10 ELSE 0.001 * (0.1 + 0.9 * 0.5 * (1 + cos(d * pi()))) END, 9) AS cosine,
       round(CASE WHEN step < 10 THEN 0.001 * step / 10 ELSE 0.001 * (1 - 0.9 * d) END, 9) AS linear, round(0.001 * pow(0.5, floor(step / 50)), 9) AS step_,
       round(CASE WHEN step < 10 THEN 0.001 * step / 10 ELSE 0.001 * sqrt(10.0 / step) END, 9) AS inverse_sqrt FROM s
""")
def lr_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates at each order, a step of which is a day since the first."""
    of = {
        "constant": training.Schedule(), "cosine": training.Schedule("cosine", 10, 200), "linear": training.Schedule("linear", 10, 200),
        "step_": training.Schedule("step", every=50), "inverse_sqrt": training.Schedule("inverse_sqrt", 10),
    }
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", at.alias("at"))
    first = orders.agg(F.min("at")).first()[0]
    steps = orders.select("o_orderkey", (F.floor((F.col("at") - F.lit(first)) / 8.64e10) + 1).cast("bigint").alias("step"))
    return steps.select("o_orderkey", "step", *[F.round(s.at(1e-3, F.col("step")), 9).alias(k) for k, s in of.items()])


@query(f"""
WITH l AS {LONG}, n AS (SELECT count(*) AS n FROM embeddings),
w AS (SELECT d, c, ((d * 3 + c * 5) % 13) / 13.0 - 0.5 AS w FROM range(64) a(d), range(10) b(c)),
z AS (SELECT i0, label, c, sum(v * w) AS z FROM l JOIN w ON i1 = d GROUP BY ALL),
p AS (SELECT i0, c, exp(z - max(z) OVER (PARTITION BY i0)) / sum(exp(z)) OVER (PARTITION BY i0) * exp(max(z) OVER (PARTITION BY i0)) - CASE WHEN c = label THEN 1 ELSE 0 END AS e FROM z)
SELECT i1 AS i0, c AS i1, round(sum(v * e) / any_value(n), 6) + 0.0 AS g FROM l JOIN p USING (i0), n GROUP BY l.i1, c
""")
def linear_ce_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient of a linear classifier's mean loss, by the reverse-mode plan; what is used twice is written."""
    x = vector_tensor(spark, sf_dir)
    w = autodiff.Var(TensorFrame.generated(spark, (64, 10), lambda d, c: F.pmod(d * 3 + c * 5, F.lit(13)) / 13.0 - 0.5), "w")
    hot = indexing.one_hot(TensorFrame.of(vectors(spark, sf_dir), ["vec_id"], "label", x.shape[:1]), 10)
    with autodiff.written(settled):
        return cells(autodiff.backward(autodiff.cross_entropy(autodiff.matmul(autodiff.Var(x), w), hot))["w"], "g")


# Sampling and language modelling


@query(f"""
WITH z AS (SELECT i0 AS seq, generate_subscripts(z, 1) - 1 AS token, unnest(z) / 0.7 AS z FROM {LOGITS}),
k AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY z DESC, token) AS rank FROM z QUALIFY rank <= 6),
p AS (SELECT *, exp(z - max(z) OVER (PARTITION BY seq)) / sum(exp(z)) OVER (PARTITION BY seq) * exp(max(z) OVER (PARTITION BY seq)) AS p FROM k),
n AS (SELECT *, sum(p) OVER (PARTITION BY seq ORDER BY rank ROWS UNBOUNDED PRECEDING) - p AS before FROM p QUALIFY before < 0.8)
SELECT seq, token, round(p / sum(p) OVER (PARTITION BY seq), 6) AS p, rank FROM n
""")
def topk_topp_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = logits(spark, sf_dir).select(F.col("i0").alias("seq"), F.posexplode("z").alias("token", "logit"))
    p = sampling.Sampler(temperature=0.7, top_k=6, top_p=0.8).probabilities(z.withColumn("token", F.col("token").cast("bigint")))
    return p.select("seq", "token", r6("p").alias("p"), F.col("rank").cast("bigint").alias("rank"))


WORDS = """(SELECT conv_id, turn, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM
  (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda u: u != '') AS w FROM conversations WHERE text IS NOT NULL))"""


def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    words = F.filter(F.split("text", " "), lambda u: u != "")
    pairs = F.when(F.size(words) > 1, F.arrays_zip(F.slice(words, F.lit(1), F.size(words) - 1).alias("token"), F.slice(words, F.lit(2), F.size(words) - 1).alias("next")))
    return turns.select(F.explode(pairs).alias("p")).groupBy("p.token", "p.next").agg(F.count("*").alias("n"))


@query(f"""
WITH w AS {WORDS}, b AS (SELECT a.word AS token, z.word AS next, count(*) AS n FROM w a JOIN w z ON a.conv_id = z.conv_id AND a.turn = z.turn AND z.i = a.i + 1 GROUP BY ALL),
t AS (SELECT token, sum(n) AS total FROM b GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(-n * ln(n / total)) / sum(n), 6) AS loss, round(exp(sum(-n * ln(n / total)) / sum(n)), 6) AS perplexity FROM b JOIN t USING (token)
""")
def next_token_bigram_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bigram_counts(spark, sf_dir)
    both = b.join(b.groupBy("token").agg(F.sum("n").alias("total")), "token")
    loss = F.sum(-F.col("n") * F.log(F.col("n") / F.col("total"))) / F.sum("n")
    return both.agg(F.sum("n").alias("n"), loss.alias("loss")).select("n", r6("loss").alias("loss"), r6(F.exp("loss")).alias("perplexity"))


@query(f"""
WITH r AS (SELECT i0, i1, v AS x, xor(i0 * 64 + i1, 1234) AS a FROM {LONG}),
b AS (SELECT i0, i1, x, (xor(a, a >> 16)::HUGEINT * 2146121005 % 4294967296)::BIGINT AS a FROM r),
c AS (SELECT i0, i1, x, (xor(a, a >> 15)::HUGEINT * 2221713035 % 4294967296)::BIGINT AS a FROM b),
d AS (SELECT i0, i1, x, xor(a, a >> 16) AS a FROM c)
SELECT i0, i1, CASE WHEN (a >> 8) / 16777216.0 < 0.75 THEN round(x / 0.75, 6) + 0.0 ELSE 0 END AS v FROM d
""")
def dropout_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(elemwise.dropout(vector_tensor(spark, sf_dir), 0.25, 1234))


@query(f"""
SELECT 'layer.' || label || '.weight' AS name, [count(*) // 64, 64] AS shape, round(sum(v), 3) + 0.0 AS total FROM {LONG} WHERE label < 5 GROUP BY label
""")
def state_dict_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of each label as a parameter; entries of the labels under 5 by their names."""
    return _totals(state.filtered(_label_states(spark, sf_dir), "weight"))


def _label_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    parts = {f"layer.{k}.{'weight' if k < 5 else 'bias'}": TensorFrame.from_rows(rows.where(F.col("label") == k), ["r"], "x", (n, 64)) for k, n in sizes.items()}
    return state.state_dict(spark, parts)


def _totals(kept: DataFrame) -> DataFrame:
    total = F.sum(F.aggregate("data", F.lit(0.0), lambda s, v: s + v.cast("double")))
    return kept.groupBy("name", "shape").agg((F.round(total, 3) + 0.0).alias("total"))


@query(f"""
SELECT form, 'layer.' || label || '.weight' AS name, [count(*) // 64, 64] AS shape, round(sum(v), 3) + 0.0 AS total
FROM {LONG}, (SELECT unnest(['parquet', 'nested']) AS form) WHERE label < 5 GROUP BY form, label
""")
def state_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same parameters written in two forms and read again, only those with weight in their names."""
    found, states = None, settled(_label_states(spark, sf_dir))
    for form in ("parquet", "nested"):
        path = shared_path(spark, form)
        state.save(states, path, form)
        own = _totals(state.load(spark, path, form, "weight")).select(F.lit(form).alias("form"), "name", "shape", "total")
        found = own if found is None else found.unionByName(own)
    return found


@query(f"""
WITH RECURSIVE w AS {WORDS}, b AS (SELECT a.word AS token, z.word AS next, count(*) AS n FROM w a JOIN w z ON a.conv_id = z.conv_id AND a.turn = z.turn AND z.i = a.i + 1 GROUP BY ALL),
best AS MATERIALIZED (SELECT token, next FROM (SELECT token, next, row_number() OVER (PARTITION BY token ORDER BY n DESC, next DESC) AS k FROM b) WHERE k = 1),
g AS (
  SELECT conv_id * 1000 + turn AS seq, 0 AS pos, split_part(text, ' ', 1) AS token FROM conversations WHERE text IS NOT NULL AND split_part(text, ' ', 1) != ''
  UNION ALL SELECT seq, pos + 1, next FROM g JOIN best USING (token) WHERE pos < 8)
SELECT seq, pos, token FROM g
""")
def generate_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight words after the first word of each turn, greedily by the bigram counts."""
    counts = settled(bigram_counts(spark, sf_dir))
    best = counts.groupBy("token").agg(F.max(F.struct("n", "next")).alias("b")).select("token", F.col("b.next").alias("next"), F.col("b.n").alias("n"))
    turns = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    first = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.lit(0).alias("pos"), F.split("text", " ")[0].alias("token")).where("token != ''")

    def next_logits(tokens: DataFrame) -> DataFrame:
        last = tokens.groupBy("seq").agg(F.max_by("token", "pos").alias("token"))
        return last.join(best, "token").select("seq", F.col("next").alias("token"), F.log("n").alias("logit"))

    return sampling.generate(first, next_logits, sampling.Sampler(temperature=0), settled, most=8)


