import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate.llm import jaccard as J
from ordinate.llm import links

from .helpers import docs, table


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    lists = {}
    for k, s in enumerate(sets):
        for g in s:
            lists.setdefault(g, []).append(k)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in lists[g] if j < k).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(sets[k]), low.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def run(spark, rows):
    return sorted([tuple(r) for r in J.cluster(docs(spark, rows).repartition(3)).collect()], key=str)


def near_copies(seed, n, words, edits):
    r = random.Random(seed)
    base = [f"w{r.randint(0, 5000)}" for _ in range(words)]
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"x{r.randint(0, 10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("block", [800, 7])
def test_against_brute_force(spark, monkeypatch, block):
    """Groups around the threshold, a large group over many blocks, a line that most documents share, exact copies."""
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(links, "SIDE", block)
    r, rows = random.Random(1), []
    for seed in range(12):
        rows += near_copies(seed, 6, 60, 5)
    rows += near_copies(99, 60, 80, 4)
    common = " ".join(f"c{k}" for k in range(12))
    rows += [f"{common} " + " ".join(f"u{r.randint(0, 10**6)}" for _ in range(r.randint(2, 40))) for _ in range(60)]
    rows += [rows[0]] * 30 + ["One two THREE", "one two three", "a b c d e", "a b c d e f"]
    numbered = list(enumerate(rows))
    r.shuffle(numbered)
    assert run(spark, numbered) == brute(numbered)


def test_against_brute_force_on_the_fixture(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_a_chain_of_shared_shingles(spark):
    """Ten thousand documents, each with a passage of the one before and one of the one after: not similar, so each is its own."""
    passage = lambda k: " ".join(f"p{k}x{i}" for i in range(12))
    rows = [(k, f"{passage(k)} {passage(k + 1)}") for k in range(10_000)]
    got = J.cluster(docs(spark, rows))
    assert got.where("component_id != doc_id OR n_shingles != 20").count() == 0 and got.count() == 10_000


def test_divide_skip():
    r = random.Random(4)
    for _ in range(200):
        query = sorted(r.sample(range(60), r.randint(1, 40)))
        sets = [sorted(r.sample(range(60), r.randint(1, 40))) for _ in range(r.randint(1, 9))] + [query]
        want = [k for k, s in enumerate(sets) if 100 * len({*s} & {*query}) >= 75 * len({*s} | {*query})]
        assert J.divide_skip(np.array(query, np.uint64), [np.array(s, np.uint64) for s in sets]) == want


def test_edges(spark):
    long = "y " * 300 + " ".join(f"z{k}" for k in range(30000))
    rows = [(1, None), (1, None), (2, ""), (3, " \t\n"), (None, "a b c d e f g"), (9, "A B C D E F G"), (9, "A B C D E F G"), (None, None), (4, long), (5, long), (None, "only null"), (None, "ONLY null")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_keep_one_and_clashing_columns(spark):
    given = docs(spark, [(2, "a b c d e f g"), (1, "a b c d e f g"), (3, "other words here"), (None, "a b c d e f g"), (4, None)])
    given = given.withColumns({"component_id": F.lit("x"), "gone_id": F.lit(1), "signature": F.lit(2)})
    kept = J.keep_one(given)
    assert kept.columns == given.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None"]
