"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by documents: each row is a segment of some documents with all of its terms and, for each, the
positions of its occurrences. A term that is everywhere is so spread over all segments, and no list of it
meets in one task. Test phrases are searched in each segment: those whose terms the segment has are found by their rarest
term in the corpus, and the offset-adjusted position lists of their terms are intersected from that one on, for
many phrases at once, until no start is left.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flagged, fresh, prepare, slices, small, texts, written

#: Windows of a test item, in words.
WINDOW = 10
#: Bytes of text in a segment of the index, about.
SEGMENT_BYTES = 2 << 20
#: Bytes of segments that a row group of the written index has, about: a task decodes one at a time.
GROUP_BYTES = 4 << 20
#: Words (and so windows) of test items that one round of the search takes, about: 200 MB on the driver, 60 MB in a worker.
ROUND_WORDS = 1 << 20
#: Pairs of a phrase and a place that are intersected at a time.
STEP = 1 << 19
#: Positions between two documents of a segment are further apart than any phrase reaches.
GAP = 1 << 10

_TABLE = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256)).lower()
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

INDEX_SCHEMA = "doc_ids array<bigint>, starts array<bigint>, lengths array<bigint>, terms array<binary>, counts array<bigint>, positions binary"
MATCH_SCHEMA = "doc_id bigint, phrase_id string, position bigint, exact boolean"
REPORT_SCHEMA = (
    "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, "
    "items array<string>, spans array<struct<start: bigint, stop: bigint>>"
)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and non-ASCII characters; none of a null."""
    return text.translate(_TABLE).split() if text else []


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers by bytes of equal rank: small ones compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def build_index(docs: DataFrame) -> DataFrame:
    """Postings of docs(doc_id, text) by segment, of all terms.

    Null and empty texts have a document entry without words. Repeated rows are documents of their own. positions: those
    of each term in turn, as differences (a term's first one from 0).
    """
    prepare(docs.sparkSession)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SEGMENT_BYTES):
            own: dict[bytes, int] = {}
            codes, lengths = [], []
            for value in batch.column("text"):
                buffer = value.as_buffer()
                found = words(buffer.to_pybytes() if buffer is not None else None)
                lengths.append(len(found))
                codes.append(np.fromiter((own.setdefault(w, len(own)) for w in found), np.int64, len(found)))
            n = np.array(lengths, np.int64)
            starts = np.concatenate([[0], np.cumsum(n + GAP)[:-1]]).astype(np.int64)
            term = np.concatenate(codes) if codes else np.zeros(0, np.int64)
            position = np.repeat(starts, n) + np.arange(len(term)) - np.repeat(np.cumsum(n) - n, n)
            order = np.argsort(term, kind="stable")
            position = position[order]
            count = np.bincount(term, minlength=len(own))
            steps = np.diff(position, prepend=0)
            first = np.cumsum(count) - count
            steps[first] = position[first]
            columns = ([batch.column("doc_id").to_pylist()], [starts.tolist()], [lengths], [list(own)], [count.tolist()], [_planes(steps)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("bigint"), texts().alias("text")).mapInArrow(segments, INDEX_SCHEMA)


_LONGS = pa.list_(pa.int64())
_ARROW = pa.schema([("doc_ids", _LONGS), ("starts", _LONGS), ("lengths", _LONGS), ("terms", pa.list_(pa.binary())), ("counts", _LONGS), ("positions", pa.binary())])


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n): occurrences of each term in the corpus, by a grouped sum over all segments."""
    p = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("p"))
    return p.groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.counts").alias("n"))


def _counts_of(index: DataFrame, vocabulary: Iterable[bytes]) -> dict[bytes, int]:
    """The counts of the terms of a bounded vocabulary that occur."""
    spark = index.sparkSession
    wanted = spark.createDataFrame(pa.table({"term": pa.array(sorted(vocabulary), pa.binary())}))
    return {bytes(r.term): r.n for r in term_counts(index).join(small(wanted), "term").collect()}


class _Segment:
    """The lists of one segment of the index: keys are (term, position) as one number, sorted."""

    SHIFT = 40

    def __init__(self, row: dict) -> None:
        self.doc_ids, self.starts, self.lengths = row["doc_ids"], np.array(row["starts"], np.int64), np.array(row["lengths"], np.int64)
        self.size = int(self.starts[-1] + self.lengths[-1]) if len(self.starts) else 0
        self.terms, self.count = row["terms"], np.array(row["counts"], np.int64)
        steps = _numbers(row["positions"])
        self.first = np.cumsum(self.count) - self.count
        sums = np.cumsum(steps)
        base = np.repeat(sums[self.first] - steps[self.first], self.count)
        self.positions = sums - base
        self.keys = (np.repeat(np.arange(len(self.count)), self.count) << self.SHIFT) | self.positions

    def postings(self, k: int) -> np.ndarray:
        return self.positions[self.first[k] : self.first[k] + self.count[k]]

    def find(self, terms: list[tuple[int, int]], slop: int = 0) -> np.ndarray:
        """Starts at which each of the terms (number, offset) stands at its offset, or off it by slop words at most."""
        (term, offset), *others = terms
        starts = self.postings(term) - offset
        for term, offset in others:
            postings = self.postings(term)
            at = np.searchsorted(postings, starts + (offset - slop))
            at[at == len(postings)] = len(postings) - 1
            starts = starts[np.abs(postings[at] - starts - offset) <= slop]
        return starts

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, "right") - 1


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[_Segment]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Segment(batch.slice(i, 1).to_pylist()[0])


def match(index: DataFrame, phrases: dict[str, str], slop: int = 0) -> DataFrame:
    """(doc_id, phrase_id, position, exact): where the phrases of a bounded set occur in the indexed documents.

    With slop 0, exact phrases. Otherwise proximity matches too: from the rarest term, each other term stands
    within slop words of its place. Phrases without words match nothing. position is that of the phrase's first
    word, from 0 (below 0 if a proximity match begins before the document).
    """
    owners = defaultdict(list)
    for k, v in phrases.items():
        owners[tuple(words(v.encode()))].append(k)
    counts = _counts_of(index, {w for p in owners for w in p})
    rarest = [(sorted(((w, i) for i, w in enumerate(p)), key=lambda x: (counts[x[0]], x[1])), names) for p, names in owners.items() if p and all(w in counts for w in p)]
    sent = index.sparkSession.sparkContext.broadcast(rarest)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _segments(batches):
            out = {k: [] for k in ("doc_id", "phrase_id", "position", "exact")}
            own = {w: k for k, w in enumerate(s.terms)}
            for terms, names in sent.value:
                if not all(w in own for w, _ in terms):
                    continue
                here = [(own[w], i) for w, i in terms]
                exact = set(s.find(here).tolist())
                first = here[0][1]
                for at in s.find(here, slop).tolist():
                    d = int(s.document(np.array([at + first]))[0])
                    for name in names:
                        for k, v in zip(out, (s.doc_ids[d], name, at - int(s.starts[d]), at in exact)):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("phrase_id", pa.string()), ("position", pa.int64()), ("exact", pa.bool_())]))

    return index.mapInArrow(search, MATCH_SCHEMA)


@dataclass
class Phrases:
    """The distinct windows of some test items.

    vocabulary: their terms. terms: of each window its terms as places in the vocabulary, -1 after its last. owners: of each
    window the places in items of those that have it, first[k] to first[k + 1].
    """

    vocabulary: list[bytes]
    terms: np.ndarray
    items: list[str]
    owners: np.ndarray
    first: np.ndarray


def windows(items: Iterable[tuple[object, str | None]], size: int = WINDOW) -> Phrases:
    """The distinct windows of the items' words, each with the items that have it (a null id is "null").

    A window is size consecutive words; an item of fewer words, but not none, is one window.
    """
    ids: dict[bytes, int] = {}
    names: dict[str, int] = {}
    found, of = [np.zeros((0, size), np.int32)], [np.zeros(0, np.int32)]
    for item, text in items:
        code = np.array([ids.setdefault(w, len(ids)) for w in words(text.encode() if text is not None else None)], np.int32)
        if len(code):
            code = np.append(code, np.full(max(0, size - len(code)), -1, np.int32))
            found.append(np.lib.stride_tricks.sliding_window_view(code, size))
            of.append(np.full(len(found[-1]), names.setdefault("null" if item is None else str(item), len(names)), np.int32))
    every, owner = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((owner, *every.T[::-1]))
    every, owner = every[order], owner[order]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:] != every[:-1]).any(1)
    other = new.copy()
    other[1:] |= owner[1:] != owner[:-1]
    first = np.append(np.cumsum(other)[new] - 1, other.sum()).astype(np.int64)
    return Phrases(list(ids), every[new], list(names), owner[other], first)


def _rarest_first(phrases: Phrases, counts: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the windows whose terms all occur, sorted by their rarest term; their terms from the rarest on; the offsets of these)."""
    n = np.array([counts.get(w, 0) for w in phrases.vocabulary] + [0], np.int64)  # the last is that of -1
    here = np.flatnonzero(((n[phrases.terms] > 0) | (phrases.terms < 0)).all(1))
    terms = phrases.terms[here]
    key = np.where(terms < 0, np.int64(2**62), n[terms])
    offsets = np.argsort(key, axis=1, kind="stable")
    terms = np.take_along_axis(terms, offsets, 1)
    order = np.argsort(terms[:, 0], kind="stable")
    return here[order], terms[order], offsets[order].astype(np.int32)


def _occurrences(s: _Segment, number: dict[bytes, int], terms: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, start) of what occurs in a segment, in steps. number: places of terms in the vocabulary; terms are sorted by their first."""
    own = np.full(len(number) + 1, -1, np.int64)
    for k, w in enumerate(s.terms):
        if (v := number.get(w)) is not None:
            own[v] = k
    present = np.flatnonzero(own >= 0)
    # Only windows whose rarest term the segment has are looked at.
    a, b = np.searchsorted(terms[:, 0], present), np.searchsorted(terms[:, 0], present, "right")
    n = b - a
    chosen = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
    chosen = chosen[((own[terms[chosen]] >= 0) | (terms[chosen] < 0)).all(1)]
    count = s.count[own[terms[chosen, 0]]]
    cuts = np.searchsorted(np.cumsum(count), np.arange(STEP, count.sum() + STEP, STEP)) + 1
    for part in np.split(chosen, np.unique(np.minimum(cuts, len(chosen)))):
        first = own[terms[part, 0]]
        n = s.count[first]
        at = np.repeat(s.first[first] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        window = np.repeat(part, n)
        start = s.positions[at] - offsets[window, 0]
        for k in range(1, terms.shape[1]):
            if not len(window):
                break
            term = terms[window, k]
            key = (own[term] << _Segment.SHIFT) | (start + offsets[window, k])
            place = np.minimum(np.searchsorted(s.keys, key), len(s.keys) - 1)
            hit = (term < 0) | ((s.keys[place] == key) & (start + offsets[window, k] >= 0))
            window, start = window[hit], start[hit]
        yield window, start


def _searched(index: DataFrame, phrases: Phrases, counts: dict[bytes, int], first: bool, last: bool) -> DataFrame:
    """One round of the search: the report if it is the last, else the index with what was found so far."""
    number = {w: k for k, w in enumerate(phrases.vocabulary)}
    sent = index.sparkSession.sparkContext.broadcast((number, *_rarest_first(phrases, counts), phrases))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, place, terms, offsets, phrases = sent.value
        length = (terms >= 0).sum(1)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                given = row.to_pylist()[0]
                s = _Segment(given)
                items = defaultdict(set, {} if first else {d: set(x) for d, x in enumerate(given["found"])})
                marks = np.zeros(s.size + 1, np.int32)
                for window, start in _occurrences(s, number, terms, offsets):
                    np.add.at(marks, start, 1)
                    np.add.at(marks, start + length[window], -1)
                    for d, w in np.unique(np.stack([s.document(start), place[window]], 1), axis=0).tolist():
                        items[d].update(phrases.items[k] for k in phrases.owners[phrases.first[w] : phrases.first[w + 1]].tolist())
                hit = np.cumsum(marks) > 0
                if not first:
                    hit |= np.unpackbits(np.frombuffer(given["hits"], np.uint8), count=len(hit)).astype(bool)
                if last:
                    yield _reported(s, hit, items)
                else:
                    kept = row.select(_ARROW.names).columns
                    more = [pa.array([np.packbits(hit).tobytes()], pa.binary()), pa.array([[sorted(items.get(d, ())) for d in range(len(s.doc_ids))]], _FOUND)]
                    yield pa.RecordBatch.from_arrays([*kept, *more], names=[*_ARROW.names, "hits", "found"])

    return index.mapInArrow(search, REPORT_SCHEMA if last else f"{INDEX_SCHEMA}, hits binary, found array<array<string>>")


def _reported(s: _Segment, hit: np.ndarray, items: dict[int, set[str]]) -> pa.RecordBatch:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit])))
    spans = defaultdict(list)
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        d = int(s.document(np.array([a]))[0])
        spans[d].append({"start": a - int(s.starts[d]), "stop": b - int(s.starts[d])})
    rows = []
    for d, (doc_id, n) in enumerate(zip(s.doc_ids, s.lengths.tolist())):
        found = sorted(items.get(d, ()))
        n_hit = sum(x["stop"] - x["start"] for x in spans.get(d, ()))
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        rows.append((doc_id, n, n_hit, len(found), digest, n_hit > 0, found, spans.get(d, [])))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _REPORT.types)], schema=_REPORT)


_FOUND = pa.list_(pa.list_(pa.string()))
_REPORT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("n_items", pa.int64()),
        ("items_sha256", pa.string()),
        ("contaminated", pa.bool_()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
    ]
)


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row for each row of docs: which of its words lie in an occurrence of a window of a test item.

    items are the ids (as sorted strings) of the items with occurring windows, spans the hit word ranges.
    Nulls and empty texts have no words; a null doc_id stays null; items of equal ids count once; repeated rows are reported
    each; a test set without words hits nothing; an empty table gives none. The windows of ROUND_WORDS words of tests, about, are
    broadcast; a larger test set is searched in rounds, each of which adds to what the ones before have found.
    """
    test = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    total = test.agg(F.sum(F.regexp_count("text", F.lit(WORD_PATTERN)))).first()[0] or 0
    rounds = max(1, -(-total // ROUND_WORDS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds))
    found = index = written(build_index(docs), "postings", GROUP_BYTES)
    for k in range(rounds):
        phrases = windows(((r.item_id, r.text) for r in test.where(part == k).collect()), size)
        found = _searched(found, phrases, _counts_of(index, phrases.vocabulary), k == 0, k == rounds - 1)
    return found


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs whose document holds no window of a test item.

    Rows of one doc_id go or stay together; rows without doc_id are judged each by its own text. Only rows that may go are shuffled.
    """
    name = fresh(docs, "_row")
    # A row without an id gets one for the search: a hash of its text, below all others' reach.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("i"), F.col("doc_id").cast("bigint").cast("string"))).otherwise(F.concat(F.lit("t"), F.sha2(text, 256)))
    keyed = docs.withColumn(name, F.xxhash64(own))
    hit = report(keyed.select(F.col(name).alias("doc_id"), "text"), benchmark, size).where("contaminated")
    hit = written(hit.select(F.col("doc_id").alias(f"{name}_hit")).distinct(), "hits")
    may = flagged(keyed, F.col(name), hit, f"{name}_may")
    left = may.where(f"{name}_may").join(hit.hint("merge"), F.col(name) == F.col(f"{name}_hit"), "left_anti")
    return may.where(f"NOT {name}_may").union(left).drop(name, f"{name}_may")
