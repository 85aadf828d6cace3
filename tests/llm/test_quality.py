import numpy as np
from pyspark.sql import functions as F

from ordinate.llm import quality as Q

from .helpers import docs


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = Q.train(d, labels.where(~Q.held_out()))
    scored = Q.score(d, model).join(labels, "doc_id").where(Q.held_out()).select("quality_score", "quality").toPandas()
    predicted = (scored.quality_score >= Q.THRESHOLD).astype(int)
    assert len(scored) > 50 and (predicted == scored.quality).mean() > 0.9


def test_ftrl_against_the_plain_update():
    """One row after another, each coordinate by the formula."""
    rows = [(np.array([1, 5]), np.array([0.6, 0.8]), 1), (np.array([5]), np.array([1.0]), 0), (np.array([1, 7]), np.array([0.6, 0.8]), 1)]
    z, n = {}, {}

    def w(i):
        if abs(z.get(i, 0)) <= Q.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * Q.L1) / ((Q.BETA + np.sqrt(n[i])) / Q.ALPHA + Q.L2)

    for _ in range(2):
        for idx, x, y in rows:
            old = [w(i) for i in idx]
            p = 1 / (1 + np.exp(-sum(o * v for o, v in zip(old, x))))
            for i, v, o in zip(idx, x, old):
                g = (p - y) * v
                z[i] = z.get(i, 0) + g - (np.sqrt(n.get(i, 0) + g * g) - np.sqrt(n.get(i, 0))) / Q.ALPHA * o
                n[i] = n.get(i, 0) + g * g
    got = Q.ftrl(rows, 2)
    assert all(abs(got[i] - w(i)) < 1e-12 for i in (1, 5, 7)) and np.count_nonzero(got) <= 3


def test_edges(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "a text"), (3, "word " * 40000), (4, "é ß !!! a1")]
    model = np.zeros(1 << Q.BITS)
    model[0] = 1.0
    got = Q.score(docs(spark, rows), model, "score").collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert abs([r.score for r in got if r.doc_id == 1][0] - 1 / (1 + np.exp(-1))) < 1e-6
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int")
    assert not Q.train(docs(spark, rows), none).any()
    assert Q.score(docs(spark, []), model).count() == 0
    held = {r.doc_id: r.h for r in docs(spark, [(i, "x") for i in range(40)] + [(None, "x")]).select("doc_id", Q.held_out().alias("h")).collect()}
    import zlib

    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items() if i is not None) and held[None] is False


def test_extra_columns(spark):
    given = docs(spark, [(1, "x")]).withColumns({"shard": F.lit(1), "y": F.lit(2)})
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int").withColumn("text", F.lit("clash"))
    assert Q.score(given, Q.train(given, labels)).count() == 1
