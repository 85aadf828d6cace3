import html
import math
import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from ordinate.llm import extraction as X

from .helpers import table


@pytest.fixture(scope="module")
def model():
    return X.train(X.labelled_pages())


def test_marginals_against_enumeration(model):
    """All states of small trees."""
    r = random.Random(5)
    for _ in range(20):
        nodes = [X.Node("html", -1)] + [X.Node(r.choice(["div", "p", "nav", "article"]), r.randrange(k), r.choice(["body", "div"]), (), tuple(r.choices(["ad", "post", "zz"], k=r.randint(0, 2)))) for k in range(1, r.randint(2, 9))]
        for n in nodes[1:]:
            if r.random() < 0.6:
                n.texts.append((0, "t" * r.randint(1, 300)))
        total = [[0.0, 0.0] for _ in nodes]
        for s in product((0, 1), repeat=len(nodes)):
            e = model.root[s[0]]
            for k, n in enumerate(nodes):
                e += sum(model.unary[f][s[k]] for f in X.features(n) if f in model.unary) + (model.edge[s[n.parent]][s[k]] if k else 0)
            for k, x in enumerate(s):
                total[k][x] += math.exp(e)
        for got, (a, b) in zip(X.marginals(nodes, model), total):
            assert math.isclose(got, b / (a + b), rel_tol=1e-6, abs_tol=1e-9)


def test_held_out_pages(model):
    right = n = 0
    for page in X.labelled_pages(120, 77):
        nodes = X.parse(page)
        state = [0] * len(nodes)
        for k, x in enumerate(nodes):
            state[k] = x.label if x.label is not None else state[x.parent] if k else 0
        for k, p in enumerate(X.marginals(nodes, model)):
            if nodes[k].texts:
                n, right = n + 1, right + ((p >= X.THRESHOLD) == bool(state[k]))
    assert n > 1000 and right / n > 0.95


def test_fixture_articles(spark, sf_dir, model):
    for r in X.extract(table(spark, sf_dir, "pages"), model=model).collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        body = re.sub(r"<[^>]*$", "", body)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body)]
        assert r.text == "\n\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def test_edges(spark, model):
    long = "<article>" + "<p>word &amp; word</p>" * 4000 + "</article>"
    cases = {
        1: None, 2: "", 3: "<", 4: "just text", 5: "<article><p>a &lt;b&gt; c&nbsp;d\n e</p><!-- x --><p>x<script>if (a<b) y('</p>')</script> y</article>",
        6: long, 7: "</div></p><article><p>One<p>Two<li>Three", 8: "<div class=ad>Buy", 9: "<article><h1>T</h1><p>tail &am",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(1, None)], "page_id bigint, html string").withColumns({"text": F.lit(1), "names": F.lit(2)})
    got = {r.page_id: r.text for r in X.extract(df, model=model).collect()}
    assert got[1] == got[2] == got[8] == ""
    assert got[5] == "a <b> c d e\n\nx y" and got[7] == "One\n\nTwo\n\nThree" and got[9] == "T\n\ntail &am"
    assert got[6].count("word & word") == 4000
    assert X.extract(df.limit(0), model=model).count() == 0


@pytest.mark.parametrize("words", [1, 5, 50, 1000])
def test_plain_pages(model, words):
    """Pages that say nothing of their parts are content, but for the head."""
    text = " ".join(f"word{k}" for k in range(words))
    assert X.main_text(text, model) == text
    for around in ("<html><body>{}</body></html>", "<html><head><title>a title</title></head><body>{}", "<!doctype html>{}"):
        assert X.main_text(around.format(text), model) == text
        assert X.main_text(around.format(f"<p>{text}</p>"), model) == text
        assert X.main_text(around.format(f"<h1>Head</h1><p>{text}<p>{text}"), model) == f"Head\n\n{text}\n\n{text}"
        assert X.main_text(around.format(f"<div>{text}</div><div>{text}</div>"), model) == f"{text}\n\n{text}"
        assert X.main_text(around.format(f'<nav><a href="/">menu</a></nav><div class="ad">{text}</div>'), model) == ""


@pytest.mark.parametrize("tag", ["button", "svg", "select", "iframe", "template", "datalist"])
def test_skipped_elements_that_are_not_closed(model, tag):
    """They skip only themselves; closed ones skip what they hold, blocks included."""
    body = "<p>" + "first words of the article " * 5 + "</p><p>" + "second words of it " * 5 + "</p>"
    want = X.main_text(f"<article>{body}</article><footer>copyright</footer>", model)
    assert want.startswith("first") and "second" in want and "copyright" not in want
    assert X.main_text(f"<article><div><{tag}></div>{body}</article><footer><{tag}>ok</{tag}> copyright</footer>", model) == want
    assert X.main_text(f"<article><{tag}><div>gone</div></{tag}>{body}</article><footer>copyright</footer>", model) == want
