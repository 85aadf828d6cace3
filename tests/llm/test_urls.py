import random

from pyspark.sql import functions as F

from ordinate.llm import urls as U


def judged(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    listed = any(x in U.LISTED_LABELS for x in host.split("."))
    return host, path, best[2] if best else None, best[3] if best else "block" if listed else "allow"


URLS = [
    None, "", "no scheme", "http://", "https://Example.ORG/es/1?q=/de/", "http://a.example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/",
    "http://x.com/fr/a", "http://x.com/de/", "http://x.com", "http://adult-x.example.net/a", "http://m.spam-farm.net?x://y", "http://É.Com/de/ß#f", "http://h/a\nb?c",
    "http://org/", "ftp://a://b/c", "http://spam-farm.example.com/fr/1", "http://" + "l" * 40000 + ".net/" + "p" * 40000,
]


def test_against_the_rules_in_python(spark):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(0, None), (100, URLS[11])]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumns({"host": F.lit(1), "key": F.lit(2), "listed": F.lit("x")})
    got = U.judged(df, U.hosts_with(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(r.url)
    assert U.judged(df.limit(0), U.hosts_with(df)).count() == 0


def test_cascade_is_exact(spark):
    r = random.Random(3)
    keys = [(f"k{n}", r.random() < 0.2) for n in range(5000)]
    universe = spark.createDataFrame(keys, "key string, listed boolean")
    c = U.Cascade(universe)
    got = universe.withColumn("found", c.contains(F.col("key")))
    assert got.where("found != listed").count() == 0 and len(c.levels[0]) > 1
    for share in (0.0, 1.0):
        whole = spark.createDataFrame([(k, share == 1.0) for k, _ in keys[:50]], "key string, listed boolean")
        assert whole.withColumn("found", U.Cascade(whole).contains(F.col("key"))).where("found != listed").count() == 0


def test_a_long_list_makes_more_cascades(spark, monkeypatch):
    df = spark.createDataFrame([(k, u) for k, u in enumerate(URLS)], "page_id bigint, url string")
    want = sorted((r.page_id, r.verdict) for r in U.judged(df, U.hosts_with(df)).collect())
    monkeypatch.setattr(U, "MAX_BITS", 8)
    assert sorted((r.page_id, r.verdict) for r in U.judged(df, U.hosts_with(df)).collect()) == want


def test_a_list_is_a_table(spark):
    """Hosts of the list that no page has, repeats and nulls do nothing; a listed host has no need of a label."""
    df = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.net/x"), (3, "nothing")], "page_id bigint, url string")
    listed = spark.createDataFrame([("a.net",), ("a.net",), (None,), ("c.net",)], "h string")
    assert {r.page_id: r.verdict for r in U.judged(df, listed).collect()} == {1: "block", 2: "allow", 3: "allow"}
