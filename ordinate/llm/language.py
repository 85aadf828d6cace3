"""Language identification by Bayesian fusion of evidence.

The evidence on a text: the likelihood of its letter trigrams, its declared markup language, the suffix of its
address, and a prior of its host that is smoothed towards its domain's, which is smoothed towards the corpus's.
All four are learned from the corpus by grouped aggregation: trigram counts from the texts of each declared
language, the rest from the languages that the text alone makes likeliest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat_list, fresh, prepare, small, texts, written

#: Hash buckets of letter trigrams.
BUCKETS = 1 << 14
#: Documents with texts that must declare a language for it to be modelled, whatever their share.
MIN_DOCUMENTS = 1
#: Trigrams whose likelihood counts in full; that of longer texts is scaled down to so many, as neighbours depend on each other.
MOST_TRIGRAMS = 60
#: Pseudo-counts: of trigrams, of declared languages and suffixes, and of the smoothing of hosts and domains.
ALPHA, ALPHA_EVIDENCE, KAPPA = 0.5, 1.0, 20.0
#: Share of trigrams in any text that are of no language (names, keys, codes), and uniform.
NOISE = 0.1
#: Prior of texts in none of the languages, under which all trigrams are uniform.
UNKNOWN = 1e-4
#: Posterior from which a document is accepted.
MIN_CONFIDENCE = 0.5
#: Name of no language.
UNDETERMINED = "und"

_LETTERS = bytes(c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in range(256)).lower()


def trigrams(text: bytes | None) -> np.ndarray:
    """Buckets of the letter trigrams of a text, word edges included; none of a text without letters."""
    words = text.translate(_LETTERS).split() if text else []
    if not words:
        return np.zeros(0, np.uint32)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D) << np.uint32(1))
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 14)


def trigram_counts(docs: DataFrame, text: str, declared: str) -> DataFrame:
    """(declared, bucket, n) over all texts: each task counts what it reads, a grouped sum adds the tasks up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for code, value in zip(batch.column("declared").to_pylist(), batch.column("text")):
                got = trigrams(value.as_buffer().to_pybytes())
                if code not in sums:
                    sums[code] = np.zeros(BUCKETS, np.int64)
                sums[code] += np.bincount(got, minlength=BUCKETS)
        for code, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"declared": [code] * len(at), "bucket": at, "n": n[at]}, schema=kind)

    kind = pa.schema([("declared", pa.string()), ("bucket", pa.int64()), ("n", pa.int64())])
    rows = docs.select(_code(F.col(declared)).alias("declared"), texts(text).alias("text")).where("declared IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(count, "declared string, bucket bigint, n bigint").groupBy("declared", "bucket").agg(F.sum("n").alias("n"))


def _code(column: Column) -> Column:
    """The primary subtag of a declared language: of "en-GB" en; null for blanks."""
    code = F.lower(F.regexp_extract(column.cast("string"), r"^\s*([A-Za-z]{2,8})", 1))
    return F.when(code != "", code)


@dataclass
class Model:
    """languages, the last of them UNDETERMINED; log_p: log-likelihoods of the buckets, a row for each language."""

    languages: list[str]
    log_p: np.ndarray


def train(docs: DataFrame, text: str = "text", declared: str = "lang") -> Model:
    """Trigram likelihoods of the languages that at least MIN_DOCUMENTS rows with texts declare (64 KB each on the driver and in the broadcast)."""
    prepare(docs.sparkSession)
    code = docs.where(F.col(text).isNotNull()).groupBy(_code(F.col(declared)).alias("code")).count().where("code IS NOT NULL")
    chosen = sorted(r.code for r in code.where(F.col("count") >= MIN_DOCUMENTS).collect())
    n = np.zeros((len(chosen) + 1, BUCKETS))
    if chosen:
        got = trigram_counts(docs.where(_code(F.col(declared)).isin(chosen)), text, declared).toArrow()
        row = np.searchsorted(chosen, got.column("declared").to_pylist()) if got.num_rows else np.zeros(0, np.int64)
        n[row, got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    n[-1] = 0
    p = (1 - NOISE) * (n + ALPHA) / (n + ALPHA).sum(1, keepdims=True) + NOISE / BUCKETS
    return Model([*chosen, UNDETERMINED], np.log(p).astype(np.float32))


def log_likelihoods(docs: DataFrame, model: Model, text: str, out: str) -> DataFrame:
    """docs with an array of the text's log-likelihood under each language, scaled to MOST_TRIGRAMS; zeros without letters."""
    sent = docs.sparkSession.sparkContext.broadcast(model.log_p)
    k = len(model.languages)

    @F.arrow_udf("array<float>")
    def scored(column: pa.Array) -> pa.Array:
        log_p, rows = sent.value, np.zeros((len(column), k), np.float32)
        for i, value in enumerate(column):
            buffer = value.as_buffer()
            got = trigrams(buffer.to_pybytes() if buffer is not None else None)
            if len(got):
                n = np.bincount(got, minlength=BUCKETS)
                at = np.flatnonzero(n)
                rows[i] = log_p[:, at] @ n[at].astype(np.float32) * min(1.0, MOST_TRIGRAMS / len(got))
        return flat_list(rows.ravel(), np.full(len(rows), k), pa.float32())

    once = scored.asNondeterministic()  # else a filter on the result would compute it twice
    return docs.withColumn(out, once(texts(text)))


def _host_parts(host: Column) -> tuple[Column, Column]:
    """The domain (last two labels) and the suffix (last label) of a host; null without a dot, as nothing but the host is known then."""
    domain = F.when(host.contains("."), F.substring_index(host, ".", -2))
    suffix = F.when(host.contains("."), F.lower(F.substring_index(host, ".", -1)))
    return domain, suffix


def _sums(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """For each of keys, the array of its documents by language."""
    return counts.groupBy(*keys).agg(F.array(*[F.sum(F.when(F.col("best") == i, F.col("n")).otherwise(0)).cast("double") for i in range(k)]).alias("by"))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def identify(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source", model: Model | None = None) -> DataFrame:
    """docs with language, confidence and accepted, columns that replace any of these names.

    host names the column of hosts or other origins; a suffix is taken from it where it holds a dot. Any evidence
    may be null and then says nothing. A text that is null or without letters is UNDETERMINED with confidence 0.
    accepted: the likeliest is a language (not UNDETERMINED) with MIN_CONFIDENCE or more. Ties go to the code that
    sorts first. Texts of any length are read whole. Repeated rows are judged alike; an empty table stays empty.
    """
    prepare(docs.sparkSession)
    model = model or train(docs, text, declared)
    k = len(model.languages)
    pre = fresh(docs, "_lid")
    n = lambda name: f"{pre}{name}"
    host_of = F.lower(F.col(host).cast("string"))
    domain_of, suffix_of = _host_parts(host_of)
    keyed = docs.withColumns({n("host"): host_of, n("domain"): domain_of, n("suffix"): suffix_of, n("code"): _code(F.col(declared))})
    scored = log_likelihoods(keyed, model, text, n("text"))
    letters = F.exists(n("text"), lambda x: x != 0)

    best = F.array_position(n("text"), F.array_max(n("text"))).cast("int") - 1
    counts = scored.where(letters).select(F.col(n("host")).alias("h"), F.col(n("domain")).alias("d"), F.col(n("suffix")).alias("s"), F.col(n("code")).alias("c"), best.alias("best"))
    counts = written(counts.groupBy("h", "d", "s", "c", "best").agg(F.count("*").alias("n")), "evidence")

    everywhere = {r.best: r.n for r in counts.groupBy("best").agg(F.sum("n").alias("n")).collect()}  # a row for each language
    n_docs, base = sum(everywhere.values()), np.array([everywhere.get(i, 0) + 1.0 for i in range(k)])
    base[-1] = UNKNOWN * (n_docs + k)
    base = (base / base.sum()).tolist()
    flat = F.array(*[F.lit(p) for p in base])

    def smoothed(by: Column, towards: Column) -> Column:
        return F.zip_with(by, towards, lambda n, p: (n + KAPPA * p) / (_total(by) + KAPPA))

    def likelihood(key: str) -> DataFrame:
        """log P(key | language) for each value of key: its share among the language's documents."""
        rows = _sums(counts.where(F.col(key).isNotNull()), [key], k)
        distinct = F.lit(float(rows.count() + 1))
        all_of = F.array(*[F.lit(float(everywhere.get(i, 0))) for i in range(k)])
        share = F.zip_with("by", all_of, lambda n, t: F.log((n + ALPHA_EVIDENCE) / (t + ALPHA_EVIDENCE * distinct)))
        return rows.select(F.col(key).alias(n(f"key_{key}")), share.alias(n(f"log_{key}")))

    domains = _sums(counts.where("d IS NOT NULL"), ["d"], k).select(F.col("d").alias("dd"), smoothed(F.col("by"), flat).alias("of_domain"))
    hosts = _sums(counts.where("h IS NOT NULL"), ["h", "d"], k).join(small(written(domains, "domains")), F.col("d") == F.col("dd"), "left")
    prior = F.transform(smoothed(F.col("by"), F.coalesce("of_domain", flat)), lambda p: F.log(p))
    hosts = written(hosts.select(F.col("h").alias(n("key_h")), prior.alias(n("log_h"))), "hosts")

    out = scored.join(small(hosts), F.col(n("host")) == F.col(n("key_h")), "left")
    for key, column in (("c", n("code")), ("s", n("suffix"))):
        out = out.join(small(written(likelihood(key), "likelihood")), F.col(column) == F.col(n(f"key_{key}")), "left")

    zeros = F.array_repeat(F.lit(0.0), k)
    log_base = F.array(*[F.lit(float(np.log(p))) for p in base])
    terms = [F.col(n("text")), F.coalesce(n("log_h"), log_base), F.coalesce(n("log_c"), zeros), F.coalesce(n("log_s"), zeros)]
    joint = terms[0]
    for t in terms[1:]:
        joint = F.zip_with(joint, t, lambda a, b: a + b)
    out = out.withColumn(n("joint"), joint)
    top = F.array_max(n("joint"))
    share = 1 / F.aggregate(F.col(n("joint")), F.lit(0.0), lambda s, x: s + F.exp(x - top))
    named = F.element_at(F.array(*[F.lit(x) for x in model.languages]), F.array_position(n("joint"), top).cast("int"))
    out = out.withColumns({"language": F.when(letters, named).otherwise(UNDETERMINED), "confidence": F.when(letters, share).otherwise(0.0)})
    out = out.withColumn("accepted", (F.col("language") != UNDETERMINED) & (F.col("confidence") >= MIN_CONFIDENCE))
    return out.drop(*[c for c in out.columns if c.startswith(pre)])


def address_host(url: str) -> Column:
    """The host of a url column: what follows the first :// up to a slash, question mark, number sign, colon or the end."""
    host = F.regexp_extract(F.col(url).cast("string"), r"(?s)^.*?://([^/?#:]*)", 1)
    return F.when(host != "", F.lower(host))


def markup_language(html: str) -> Column:
    """What the html element of an html column declares as its language."""
    declared = F.regexp_extract(F.col(html).cast("string"), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return F.when(declared != "", declared)


def identify_pages(pages: DataFrame) -> DataFrame:
    """identify() for pages(page_id, url, html): markup language, address suffix and host come from html and url."""
    plain = F.regexp_replace(F.col("html").cast("string"), r"(?s)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>|&[#\w]+;?", " ")
    rows = pages.select("page_id", "url", plain.alias("text"), markup_language("html").alias("lang"), address_host("url").alias("host"))
    return identify(rows, "text", "lang", "host").drop("text")


