import math

import pytest
from pyspark.sql import functions as F

from ordinate.llm import mixing as M

from .helpers import docs, table


def test_marginals_and_expected_tokens(spark, sf_dir):
    """After raking, the last marginal is exact and the others are close; probabilities give the wanted tokens."""
    d = table(spark, sf_dir, "documents")
    text = F.col("text")
    by = {"source": F.col("source"), "lang": F.col("lang"), "topic": M.topic_of(text)}
    cells = M.cells_of(d, by, M.tokens_of(text)).cache()
    w = M.fitted(cells).toPandas()
    for k, power in M.POWERS.items():
        share = (w.groupby(k).tokens.sum() / w.tokens.sum()) ** power
        got = w.groupby(k).weight.sum()
        assert ((got - share / share.sum()).abs() < 1e-8).all()
    p = M.calibrated(spark.createDataFrame(w)).toPandas()
    assert p.probability.between(0, 1).all() and math.isclose((p.probability * p.tokens).sum(), M.SHARE * p.tokens.sum(), rel_tol=1e-6)


def test_given_targets(spark):
    rows = [(k, "one two three four", lang, src) for k, (lang, src) in enumerate([("en", "a"), ("en", "b"), ("de", "a"), ("de", "b"), ("de", "b")] * 20)]
    d = docs(spark, rows)
    by = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.lit("t")}
    targets = {"source": spark.createDataFrame([("a", 0.7), ("b", 0.3)], "source string, target double"), "lang": spark.createDataFrame([("en", 0.5), ("de", 0.5)], "lang string, target double")}
    w = M.fitted(M.cells_of(d, by, M.tokens_of(F.col("text"))), {"source": 1.0, "lang": 1.0}, targets).toPandas()
    assert abs(w[w.source == "a"].weight.sum() - 0.7) < 1e-6 and abs(w[w.lang == "en"].weight.sum() - 0.5) < 1e-6


def test_rounds_that_do_not_do_it_are_said(spark, sf_dir, monkeypatch):
    d = table(spark, sf_dir, "documents")
    cells = M.cells_of(d, {"source": F.col("source"), "lang": F.col("lang"), "topic": M.topic_of(F.col("text"))}, M.tokens_of(F.col("text")))
    monkeypatch.setattr(M, "SWEEPS", 1)
    with pytest.warns(UserWarning, match="off their targets"):
        M.fitted(cells)


def test_edges(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "a b", None, None), (3, "a b", None, None), (None, "c d", "en", "s"), (4, "w " * 50000, "en", "s"), (5, "[x] | y", "(none)", None)]
    given = docs(spark, rows).withColumns({"topic": F.lit(1), "_probability": F.lit(2), "tokens": F.lit(3), "weight": F.lit(4)})
    got = M.mixed(given, share=1.0).collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "3", "4", "5", "None"] and all(r.probability == 1 for r in got)
    assert M.mixed(docs(spark, [])).count() == 0
    assert M.mixed(docs(spark, [(1, None)])).count() == 0
