"""URL filters: path rules, and a cascade of Bloom filters over the hosts.

The first filter encodes the listed hosts. Its false positives over all hosts of the corpus are encoded by a
second, the listed hosts that pass the second by a third, and so on until a level has no false positives left:
over these hosts, membership is then exact, and a lookup reads bits, without a join. A longer list makes more cascades, each of the
keys of one hash class, so that no filter grows beyond MAX_BITS. DataFrame functions only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: Rules as (verdict, host, path): for the host and its subdomains, if the path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The query's list of hosts: those of the corpus with one of these labels.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
#: Bits of one filter at most, about, 4 MB. All filters go to every executor: about 7 bits for each listed key.
MAX_BITS = 1 << 25
MAX_LEVELS = 64
#: False positives of a level, at most: each level is a Spark job, so few large ones are cheaper than many small ones.
RATE = 0.1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark, number sign or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url.cast("string"), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, number sign or the end; else empty."""
    return F.coalesce(F.regexp_extract(url.cast("string"), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does; of equally long ones, the longer host's."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for given, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, given).otherwise(verdict)
    return text, verdict


def hosts_with(pages: DataFrame, labels=LISTED_LABELS, url: str = "url") -> DataFrame:
    """(host): the hosts of pages that have one of the labels, as an example of a list."""
    hosts = pages.select(host_of(F.col(url)).alias("host")).distinct()
    return hosts.where(F.arrays_overlap(F.split("host", r"\."), F.array(*[F.lit(x) for x in labels])))


class Level:
    """One Bloom filter: a written one-row table with its words of 64 bits."""

    def __init__(self, keys: DataFrame, n: int, rate: float, seed: int) -> None:
        self.size = -(-math.ceil(max(1, n) * -math.log(rate) / math.log(2) ** 2) // 64) * 64
        self.hashes, self.seed = max(1, round(self.size / max(1, n) * math.log(2))), seed
        spark = keys.sparkSession
        bits = keys.select(F.explode(F.array(*self._positions(F.col("key")))).alias("p"))
        bits = bits.groupBy(F.expr("p div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
        every = spark.range(self.size // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
        words = bits.union(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        row = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x.bits).alias("bits"))
        self.table = written(row, "bloom")  # of a bounded size

    def _positions(self, key: Column) -> list[Column]:
        a = F.pmod(F.xxhash64(key, F.lit(2 * self.seed)), F.lit(self.size))
        b = F.pmod(F.xxhash64(key, F.lit(2 * self.seed + 1)), F.lit(self.size - 1)) + 1
        return [F.pmod(a + i * b, F.lit(self.size)) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        bits = self.table.select("bits").scalar()
        set_ = [F.getbit(F.element_at(bits, (F.floor(p / 64) + 1).cast("int")), (p % 64).cast("int")) == 1 for p in self._positions(key)]
        return reduce(lambda x, y: x & y, set_)


class Cascade:
    """Exact membership of the listed among all keys of a universe.

    universe: (key, listed) with distinct keys, none null. Keys outside it may be taken for listed ones.
    """

    def __init__(self, universe: DataFrame) -> None:
        universe = written(universe.select("key", "listed"), "universe")
        n, others = (universe.agg(F.coalesce(F.count_if(x), F.lit(0))).first()[0] for x in (F.col("listed"), ~F.col("listed")))
        self.rate = min(RATE, max(1e-6, math.sqrt(0.5) * n / max(1, others)))
        bits = n * -math.log(self.rate) / math.log(2) ** 2
        self.classes = max(1, math.ceil(bits / MAX_BITS))
        self.levels = [self._levels(universe.where(self._class(F.col("key")) == i)) for i in range(self.classes)]
        dropped(universe)

    def _class(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(self.classes))

    def _levels(self, universe: DataFrame) -> list[Level]:
        inside, outside, levels = universe.where("listed").select("key"), universe.where("NOT listed").select("key"), []
        n, rate, left = inside.count(), self.rate, []
        while n:
            if len(levels) == MAX_LEVELS:
                raise RuntimeError("the cascade did not end")
            levels.append(Level(inside, n, rate, len(levels) + 1))
            inside, outside = written(outside.where(levels[-1].passes(F.col("key"))), "passed"), inside
            left.append(inside)
            n, rate = inside.count(), RATE
        dropped(*left)
        return levels

    def contains(self, key: Column) -> Column:
        out = F.lit(False)
        for i, levels in enumerate(self.levels):
            found = F.lit(False)
            for k, level in reversed(list(enumerate(levels))):
                found = level.passes(key) & ~found if k < len(levels) - 1 else level.passes(key)
            out = F.when(self._class(key) == i, found).otherwise(out) if self.classes > 1 else found
        return out


def judged(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule and verdict, which replace columns of these names.

    listed: a table whose one column has the listed hosts, in any order; repeats and nulls in it do nothing. verdict is that of
    the longest fitting rule; without one it is block if the host is listed, else allow. Null
    urls and those without :// have an empty host and path, listed if the empty host is. Repeated rows are judged alike, urls
    of any length are read whole, an empty table stays empty.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    keys = listed.select(F.col(listed.columns[0]).alias("key"), F.lit(True).alias("listed")).where("key IS NOT NULL")
    hosts = pages.select(host.alias("key"), F.lit(False).alias("listed"))
    universe = hosts.union(keys).groupBy("key").agg(F.max("listed").alias("listed"))
    parsed = pages.withColumns({"host": host, "path": path})
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    method = F.when(Cascade(universe).contains(F.col("host")), "block").otherwise("allow")
    out = parsed.withColumns({"rule": rule, "verdict": F.coalesce(verdict, method)})
    return out.select(*[c for c in out.columns if c in pages.columns or c in ("host", "path", "rule", "verdict")])
