import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate.llm import periodic as P
from ordinate.llm import queries

from .helpers import docs, table


def brute(words, shortest=12, exponent=2):
    """Every lag and word by itself."""
    found = {}
    for p in range(1, len(words) // exponent + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(shortest, exponent * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def kept(words, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def made(rng):
    """Words of small alphabets, whole repetitions of several lengths, and runs next to and over one another."""
    out = []
    for _ in range(60):
        words = [str(x) for x in rng.integers(0, rng.integers(1, 6), rng.integers(0, 90))]
        unit = [str(x) for x in rng.integers(0, 50, rng.integers(1, 15))]
        words += unit * int(rng.integers(0, 6)) + unit[: int(rng.integers(0, len(unit)))]
        out.append(words + [str(x) for x in rng.integers(0, 3, rng.integers(0, 30))])
    return out


@pytest.mark.parametrize("shortest,exponent,cells", [(12, 2, 1 << 16), (12, 2, 50), (5, 3, 1 << 16), (2, 2, 7)])
def test_scan_against_brute_force(monkeypatch, shortest, exponent, cells):
    monkeypatch.setattr(P, "CELLS", cells)
    for words in made(np.random.default_rng(shortest)):
        own = [w.encode() for w in words]
        assert P.runs_of(P.numbered(own), shortest, exponent) == brute(words, shortest, exponent)


@pytest.mark.parametrize("work,lags", [(1 << 27, 2048), (200, 3)])
def test_texts_in_one_task_and_in_ranges_of_lags(spark, monkeypatch, work, lags):
    """Long texts, dealt by ranges, give what short ones give; odd texts and clashing columns."""
    monkeypatch.setattr(P, "RANGE", work)
    monkeypatch.setattr(P, "LAGS", lags)
    texts = [" ".join(w) for w in made(np.random.default_rng(4))] + [None, "", " \t\n\x0b\f\r ", "a " * 3000, "x", "a a a a " * 9]
    given = docs(spark, list(enumerate(texts)) + [(0, texts[0]), (None, texts[63])]).withColumns({"runs": F.lit(1), "_row": F.lit("r"), "_scan": F.lit(2), "N_WORDS": F.lit(3)})
    found = P.detect(given)
    assert set(found.columns) == {"doc_id", "text", "lang", "source", "n_chars", "_row", "_scan", "n_words", "runs", "collapsed"}
    rows = found.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        words = (r.text or "").encode().split()
        want = brute([w.decode() for w in words])
        assert [tuple(x) for x in r.runs] == want
        assert (r.n_words, r.collapsed, r._row, r._scan) == (len(words), kept([w.decode() for w in words], want), "r", 2)


def test_many_distinct_words():
    """More words than 16 bits can number."""
    words = [b"%d" % k for k in range(70_000)]
    ids = P.numbered(words + words[:30] * 2)
    assert ids.dtype == np.uint32
    assert list(P.stretches(ids, 30, 30)) and P.runs_of(ids[-60:]) == [(0, 60, 30)]


def test_empty_table_and_arguments(spark):
    assert P.detect(docs(spark, [])).collect() == []
    with pytest.raises(ValueError):
        P.detect(docs(spark, []), exponent=1)


def test_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    found = queries.op11_periodic(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    checked = planted = 0
    for r in found:
        words = [w.decode() for w in (texts[r.doc_id] or "").encode().split()]
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        if n > 900 and h % 10:  # slow here
            continue
        checked += 1
        runs = brute(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept(words, runs).encode()).hexdigest()
    assert checked > 150 and planted > 10
