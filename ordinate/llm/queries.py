"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embeddings, extraction, jaccard, language, lines, mixing, negatives, periodic, quality, tokens, urls, warc
from .common import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~quality.held_out())
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels), "score")
    predicted = (F.col("score") >= quality.THRESHOLD).cast("int")
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", predicted.alias("predicted"))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("lang").alias("declared"), "language", F.round("confidence", 4).alias("confidence"), "accepted")


def llm_page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", F.col("lang").alias("declared"), "host", "language", F.round("confidence", 4).alias("confidence"), "accepted")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.cluster(table(spark, sf_dir, "documents"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judged(pages, urls.hosts_with(pages)).select("page_id", "host", "path", "rule", "verdict")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = mixing.mixed(table(spark, sf_dir, "documents"))
    return sampled.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"))


#: Rounds of raking and of raising the constant in SQL, which has no loop: more than the operator needs.
_SWEEPS, _RAISES = 40, 12


def _mixing_sql() -> str:
    """The same raking, its rounds written out."""
    topic = "CASE " + " ".join(
        f"WHEN {' OR '.join(f"contains(text, '{m}')" for m in marks)} THEN '{name}'" for name, marks in mixing.TOPICS
    )
    attributes = list(mixing.POWERS)
    ctes = [
        f"""d AS (SELECT doc_id, source, lang, {topic} ELSE '{mixing.OTHER}' END AS topic,
  coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0) AS n_tokens FROM documents)""",
        """c AS (SELECT coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, topic, sum(n_tokens) AS tokens
  FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)""",
    ]
    for k, power in mixing.POWERS.items():
        ctes.append(f"""t_{k} AS MATERIALIZED (SELECT {k}, t / sum(t) OVER () AS t_{k} FROM (
  SELECT {k}, pow(sum(tokens) / CAST((SELECT sum(tokens) FROM c) AS DOUBLE), {power}) AS t FROM c GROUP BY {k}))""")
    joins = " ".join(f"JOIN t_{k} USING ({k})" for k in attributes)
    ctes.append(f"w0 AS (SELECT *, tokens / CAST((SELECT sum(tokens) FROM c) AS DOUBLE) AS weight FROM c {joins})")
    n = 0
    for _ in range(_SWEEPS):
        for k in attributes:
            ctes.append(f"w{n + 1} AS (SELECT * REPLACE (coalesce(weight * t_{k} / nullif(sum(weight) OVER (PARTITION BY {k}), 0), 0) AS weight) FROM w{n})")
            n += 1
    ctes.append(f"w AS MATERIALIZED (SELECT source, lang, topic, tokens, weight FROM w{n})")
    ctes.append(f"k0 AS MATERIALIZED (SELECT {mixing.SHARE} * sum(tokens) AS wanted, {mixing.SHARE} * sum(tokens) / sum(weight) AS k FROM w)")
    for i in range(_RAISES):
        ctes.append(f"""k{i + 1} AS MATERIALIZED (SELECT any_value(wanted) AS wanted,
  CASE WHEN sum(CASE WHEN tokens <= k * weight THEN 0 ELSE weight END) > 0
       THEN greatest(0, any_value(wanted) - sum(CASE WHEN tokens <= k * weight THEN tokens ELSE 0 END))
            / sum(CASE WHEN tokens <= k * weight THEN 0 ELSE weight END) ELSE any_value(k) END AS k FROM w, k{i})""")
    ctes.append(f"p AS (SELECT source, lang, topic, least(1, k * weight / tokens) AS probability FROM w, k{_RAISES})")
    return f"""WITH {", ".join(ctes)}
SELECT doc_id, d.source, d.lang, d.topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(probability, 6) AS probability
FROM d JOIN p ON coalesce(d.source, '(none)') = p.source AND coalesce(d.lang, '(none)') = p.lang AND d.topic = p.topic
WHERE n_tokens > 0 AND CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / CAST(1::BIGINT << 52 AS DOUBLE) < probability"""


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.document_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.detect(docs).withColumn("best", periodic.longest(F.col("runs")))
    lines_ = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines_, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "archives")
    warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    found = warc.records(spark, folder, content=False).where("record_type IN ('response', 'revisit')")
    refers = warc.page_of("warc-refers-to-page-id")
    return found.select(warc.page_of("warc-page-id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"), "target_uri", "intact")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = negatives.integers(table(spark, sf_dir, "embeddings"))
    return negatives.mine(vectors, F.col("vec_id") % 50 == 0)


QUERIES = {
    "op11_periodic": op11_periodic,
    "op12_warc": op12_warc,
    "op13_negatives": op13_negatives,
    "op2_tokens": op2_tokens,
    "op10_extraction": op10_extraction,
    "op9_embeddings": op9_embeddings,
    "op4_mixing": op4_mixing,
    "op8_urls": op8_urls,
    "op7_lines": op7_lines,
    "op6_jaccard": op6_jaccard,
    "op1_language": op1_language,
    "llm_page_language": llm_page_language,
    "op3_quality": op3_quality,
    "op5_decontaminate": op5_decontaminate,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op12_warc": r"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, first_value(page_id) OVER w AS least, row_number() OVER w AS n FROM p WINDOW w AS (PARTITION BY payload ORDER BY page_id NULLS LAST))
SELECT page_id, octet_length(payload) AS payload_bytes,
       translate(array_to_string(list_transform(range(8), lambda k: to_base(CAST('0x' || substr(h, CAST(1 + 5 * k AS INT), 5) AS BIGINT), 32, 4)), ''),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN least END AS refers_to,
       url AS target_uri, true AS intact
FROM r
""",
    "op13_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0),
s AS MATERIALIZED (
  SELECT a.r AS a, a.vec_id AS anchor_id, a.label = v.label AS same, v.r, v.vec_id, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score
  FROM v a JOIN v ON a.r != v.r AND len(a.e) = len(v.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INT) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.a, p.r ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3
""",
    "op6_jaccard": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER.format("text")}, '[\x20\x09-\x0D]+'), lambda x: x != '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT unnest([a, b]) AS a, unnest([b, a]) AS b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {jaccard.PERCENT} * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = doc_id
""",
    "op9_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0
    AND len(list_filter(embedding, lambda y: y != 0)) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id != b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
""",
    "op4_mixing": _mixing_sql(),
    "op8_urls": rf"""
WITH p AS (
  SELECT page_id,
         coalesce({_LOWER.format("regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')")}, '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r AS (
  SELECT * FROM (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)}) AS r(verdict, rule_host, rule_path)),
f AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN len(list_intersect(string_split(host, '.'), [{", ".join(f"'{x}'" for x in urls.LISTED_LABELS)}])) > 0
                              THEN 'block' ELSE 'allow' END) AS verdict
FROM f WHERE n = 1
""",
    "op5_decontaminate": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all({_LOWER.format("text")}, '{decontaminate.WORD_PATTERN}'), []) AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all({_LOWER.format("text")}, '{decontaminate.WORD_PATTERN}') AS w
  FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i : i + 9], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT rid, item, dw.k, i FROM dw JOIN bw ON dw.k = bw.k AND dw.phrase = bw.phrase),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM m) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
""",
}
