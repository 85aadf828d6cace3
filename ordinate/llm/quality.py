"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Labelled rows are dealt by a hash of their id to shards of about SHARD_ROWS; each shard trains a model of its own in
one pass after another, and the models are averaged by a grouped sum over their non-zero weights. A model has 2**BITS
weights at most, whatever the corpus. Scores are sparse dot products of a text's n-gram counts with the weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, texts

BITS = 20
#: Labelled rows of a shard, about.
SHARD_ROWS = 2000
#: Labelled rows that a model is fitted on, about, at most: a hash of the ids thins out larger sets.
MAX_ROWS = 32_000
EPOCHS = 3
#: Of the update: step size, its offset, and the strengths of the L1 and L2 terms.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
#: Score from which a text is predicted good.
THRESHOLD = 0.7
SEED = 17
_PART_BYTES = 4 << 20

_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]+")


def _shape(token: bytes) -> int:
    """Class of a token: shouted, capitalised, lower-case, with digits; punctuation stands for itself."""
    if not token[:1].isalnum() and token[0] < 128:
        return zlib.crc32(token[:3])
    text = token.decode("utf-8", "replace")
    if any(c.isdigit() for c in text):
        return 3
    return (4 if len(text) > 1 else 1) if text.isupper() else 1 if text[:1].isupper() else 2


def features(values: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, value): counts of each text's hashed word and word-class n-grams, scaled to length 1.

    Words and pairs of them in lower case; classes, with "same as the word before" as one, up to triples. Index 0
    is the constant term. Null and empty texts have it alone.
    """
    tokens = [_TOKEN.findall(v) if v else [] for v in values]
    n = np.array([len(t) for t in tokens], np.int64)
    flat = [w for t in tokens for w in t]
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in flat), np.int64, len(flat))
    word = np.array([zlib.crc32(w.lower()) for w in ids] or [0], np.uint64)[code]
    shape = np.array([_shape(w) for w in ids] or [0], np.uint64)[code]
    row = np.repeat(np.arange(len(values), dtype=np.uint64), n)
    same = row[1:] == row[:-1]
    if len(flat):
        shape[1:][same & (code[1:] == code[:-1])] = 7
    same3 = same[1:] & same[:-1]
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    grams = [
        (row, word * a + b),
        (row[1:][same], word[:-1][same] * a + word[1:][same] * b),
        (row, shape * c + a),
        (row[1:][same], shape[:-1][same] * b + shape[1:][same] * c),
        (row[2:][same3], shape[:-2][same3] * a + shape[1:-1][same3] * c + shape[2:][same3] * b + c),
    ]
    mask = np.uint64((1 << BITS) - 1)
    keys = np.concatenate([(r << np.uint64(BITS)) | (((h ^ (h >> np.uint64(29))) * a >> np.uint64(20)) & mask) for r, h in grams])
    keys, counts = np.unique(keys, return_counts=True)
    r, index = (keys >> np.uint64(BITS)).astype(np.int64), (keys & mask).astype(np.int64)
    norm = np.sqrt(np.bincount(r, counts.astype(np.float64) ** 2, len(values)))
    value = counts / norm[r]
    every = np.arange(len(values))
    return np.concatenate([every, r]), np.concatenate([np.zeros(len(values), np.int64), index]), np.concatenate([np.ones(len(values)), value])


def _parts(values: list[bytes | None]) -> Iterator[list[bytes | None]]:
    part, size = [], 0
    for v in values:
        part.append(v)
        size += len(v or b"")
        if size > _PART_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after passes of the update over (indices, values, label) rows."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for i, x, y in rows:
            zi, ni = z[i], n[i]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g * g
    return weights(z, n)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> np.ndarray:
    """The weights learned from the documents (doc_id, text) that labels (doc_id, label 0 or 1) names.

    Null labels and ids are left out; a doc_id labelled more than once counts as 1 if any label is 1. Of more than
    max_rows labelled ids, those with the lowest hashes are taken, about max_rows. Without rows all weights are 0.
    """
    prepare(docs.sparkSession)
    marked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("bigint").alias("labelled_id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    n = marked.count()
    if n > max_rows:
        marked = marked.where(F.pmod(F.xxhash64("labelled_id", F.lit(SEED)), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
    shards = max(1, -(-min(n, max_rows) // SHARD_ROWS))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), texts().alias("text"))
    rows = rows.join(F.broadcast(marked), F.col("doc_id") == F.col("labelled_id"))  # about max_rows rows
    rows = rows.select(F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(shards)).alias("shard"), "doc_id", "text", "y")

    def fit(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("doc_id")
        given, labels_of, data = shard.column("text").to_pylist(), shard.column("y").to_pylist(), []
        at = 0
        for part in _parts(given):
            r, i, x = features(part)
            order = np.argsort(r, kind="stable")
            cuts = np.searchsorted(r[order], np.arange(1, len(part)))
            for idx, val in zip(np.split(i[order], cuts), np.split(x[order], cuts)):
                data.append((idx.astype(np.int32), val.astype(np.float32), labels_of[at]))
                at += 1
        w = ftrl(data)
        kept = np.flatnonzero(w)
        return pa.table({"i": pa.array(kept, pa.int64()), "w": pa.array(w[kept], pa.float64())})

    total = rows.groupBy("shard").applyInArrow(fit, "i bigint, w double").groupBy("i").agg(F.sum("w").alias("w")).toArrow()
    model = np.zeros(1 << BITS)
    model[total.column("i").to_numpy()] = total.column("w").to_numpy() / shards
    return model


def score(docs: DataFrame, model: np.ndarray, out: str = "quality_score") -> DataFrame:
    """docs with a column of scores from 0 to 1; null and empty texts get that of the constant term."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        w, out = sent.value, []
        for part in _parts(text.to_pylist()):
            r, i, x = features(part)
            out.append(1 / (1 + np.exp(-np.clip(np.bincount(r, w[i] * x, len(part)), -35, 35))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return docs.withColumn(out, scored(texts()))


def held_out(doc_id: str = "doc_id"):
    """Rows that no model is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("bigint").cast("string")) % 4 == 2, F.lit(False))


