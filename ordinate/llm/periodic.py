"""Periodic runs of words by an all-lag scan.

A text is an array of word numbers. It is compared with itself shifted by each lag up to n / exponent, many lags in one vector
operation, and the stretches of equal words are run-length encoded: a stretch of L equal words at lag p is a
repetition of L + p words with period p. A multiple of a period gives the same interval again, so the smallest period
of an interval is its own. Short texts are scanned where they are read. The lags of long ones are dealt in ranges,
so that no task compares more than about RANGE pairs of words, or LAGS lags of a text too long for that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, prepare, texts, written

#: Words of the shortest run, and how often its period fits into it at least.
SHORTEST, EXPONENT = 12, 2
#: Pairs of words that a task compares in one go; lags of a range at least, as each range is sent the whole text's word numbers.
RANGE, LAGS = 1 << 27, 2048
#: Ranges of a task, about.
RANGES = 128
#: Cells of a block of lags, so that it stays in the processor's cache; longest needle of the search for stretches.
CELLS, NEEDLE = 1 << 16, 64

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_RUNS_SQL = "array<struct<start: bigint, length: bigint, period: bigint>>"


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, in 16 bits where they suffice (the largest number is left free)."""
    seen: dict[bytes, int] = {}
    ids = [seen.setdefault(w, len(seen)) for w in words]
    return np.array(ids, np.uint16 if len(seen) < (1 << 16) - 1 else np.uint32)


def stretches(ids: np.ndarray, first: int, last: int, shortest: int = SHORTEST, exponent: int = EXPONENT) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(starts, lengths, lag) of what repeats at the lags first to last, long enough for a run; lags ascend."""
    n = len(ids)
    last = min(last, n // exponent)
    if n < shortest or last < first:
        return
    lags = np.arange(first, last + 1)
    least = np.maximum(shortest - lags, (exponent - 1) * lags)
    padded = np.concatenate([ids, np.full(last, np.iinfo(ids.dtype).max, ids.dtype)])
    shifted = np.ndarray((last + 1, n), ids.dtype, padded, strides=2 * padded.strides)
    step = max(1, CELLS // n)
    held = bytearray(min(step, len(lags)) * n)
    flat = np.frombuffer(held, np.bool_)
    for at in range(0, len(lags), step):
        to = min(at + step, len(lags))
        equal = flat[: (to - at) * n].reshape(to - at, n)
        np.equal(ids, shifted[first + at : first + to], out=equal)
        needle = b"\1" * min(NEEDLE, int(least[at:to].min()))
        found = held.find(needle, 0, equal.size)
        while found >= 0:
            row = found // n
            edges = np.flatnonzero(np.diff(equal[row].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            starts, ends = edges[::2], edges[1::2]
            long = ends - starts >= least[at + row]
            if long.any():
                yield starts[long], (ends - starts)[long] + int(lags[at + row]), int(lags[at + row])
            found = held.find(needle, (row + 1) * n, equal.size)


def runs_of(ids: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, by start, then period."""
    least: dict[tuple[int, int], int] = {}
    for starts, lengths, lag in stretches(ids, 1, len(ids), shortest, exponent):
        for interval in zip(starts.tolist(), lengths.tolist()):
            least.setdefault(interval, lag)
    return sorted(((s, m, p) for (s, m), p in least.items()), key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by spaces."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words)


def _lists(runs: list[list[tuple[int, int, int]]]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
    flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUNS.value_type)))


def _scan(shortest: int, exponent: int):
    kind = pa.struct([("n", pa.int64()), ("runs", _RUNS), ("kept", pa.binary())])

    @F.arrow_udf(f"struct<n: bigint, runs: {_RUNS_SQL}, kept: binary>")
    def scan(column: pa.Array) -> pa.Array:
        sizes, runs, kept = [], [], []
        for text in column:
            words = (text.as_py() or b"").split()
            own = runs_of(numbered(words), shortest, exponent) if len(words) >= shortest else []
            sizes.append(len(words))
            runs.append(own)
            kept.append(kept_words(words, own))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), _lists(runs), pa.array(kept, pa.binary())], fields=list(kind))

    return scan


def _ids(column: pa.Array) -> pa.Array:
    own = [numbered((t.as_py() or b"").split()) for t in column]
    columns = [pa.array([len(x) for x in own], pa.int64()), pa.array([x.itemsize > 2 for x in own]), pa.array([x.tobytes() for x in own], pa.binary())]
    return pa.StructArray.from_arrays(columns, names=["n", "wide", "ids"])


def _collapse(column: pa.Array, runs: pa.Array) -> pa.Array:
    own = [[(r["start"], r["length"], r["period"]) for r in x or []] for x in runs.to_pylist()]
    return pa.array([kept_words((t.as_py() or b"").split(), r) for t, r in zip(column, own)], pa.binary())


def _range_task(shortest: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row, first, last, wide, ids = (batch.column(c)[k].as_py() for c in ("row", "first", "last", "wide", "ids"))
                for starts, lengths, lag in stretches(np.frombuffer(ids, np.uint32 if wide else np.uint16), first, last, shortest, exponent):
                    n = len(starts)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(n, row), starts, lengths, np.full(n, lag))], names=["row", "start", "length", "period"])

    return run


def _long(docs: DataFrame, text: str, names: dict[str, str], shortest: int, exponent: int) -> DataFrame:
    """The same as the scan of short texts, with the lags of each text dealt in ranges."""
    row, own = fresh(docs, "_row"), fresh(docs, "_own")
    held = written(docs.withColumns({row: F.monotonically_increasing_id(), own: F.arrow_udf(_ids, "struct<n: bigint, wide: boolean, ids: binary>")(texts(text))}), "long")
    n = F.col(own).n
    lags = F.greatest(F.lit(LAGS), F.floor(F.lit(RANGE) / n)).cast("bigint")
    starts = F.when(n >= shortest, F.sequence(F.lit(1).cast("bigint"), F.floor(n / exponent), lags))
    count = held.agg(F.sum(F.greatest(F.size(starts), F.lit(0)))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-count // RANGES))
    dealt = held.select(F.col(row).alias("row"), F.col(own).wide.alias("wide"), F.col(own).ids.alias("ids"), (lags - 1).alias("more"), F.explode(starts).alias("first"))
    dealt = dealt.select("row", "first", (F.col("first") + F.col("more")).alias("last"), "wide", "ids").repartition(parts, "row", "first")
    found = dealt.mapInArrow(_range_task(shortest, exponent), "row bigint, start bigint, length bigint, period bigint")
    found = found.groupBy("row", "start", "length").agg(F.min("period").alias("period"))
    runs = found.groupBy("row").agg(F.collect_list(F.struct("start", "period", "length")).alias("runs"))
    runs = runs.select(F.col("row").alias(f"{row}r"), F.transform(F.array_sort("runs"), lambda r: F.struct(r.start, r.length, r.period)).alias(names["runs"]))
    out = held.join(runs, F.col(row) == F.col(f"{row}r"), "left").withColumn(names["n_words"], n)
    out = out.withColumn(names["runs"], F.coalesce(names["runs"], F.array().cast(_RUNS_SQL)))
    return out.withColumn(names["collapsed"], F.arrow_udf(_collapse, "binary")(texts(text), F.col(names["runs"])).cast("string")).drop(row, own, f"{row}r")


def detect(docs: DataFrame, text: str = "text", shortest: int = SHORTEST, exponent: int = EXPONENT) -> DataFrame:
    """docs with n_words, runs (start, length, period; by start, then period) and collapsed, the text without repeats.

    Words are what lies between spaces and the control characters tab to carriage return. A run is a stretch of shortest words or more that repeats
    with a period that fits exponent times or more, and that no neighbouring word extends; its period is the smallest. collapsed has the words that no
    run contains after its first period, one space between two. A null text, an empty one or one of separators has no words, no runs and an empty
    collapsed text. Long texts are scanned whole, by several tasks; repeated rows are judged singly; an empty table gives an empty one. Columns of docs
    with the names of results are replaced, all others are kept.
    """
    if exponent < 2 or shortest < 2:
        raise ValueError("a run repeats: exponent and shortest must be 2 or more")
    prepare(docs.sparkSession)
    names = {c: fresh(docs.drop("n_words", "runs", "collapsed"), f"_{c}") for c in ("n_words", "runs", "collapsed")}
    # Words and separators take two bytes at least, so that shorter texts surely are within one range.
    limit = 2 * int((RANGE * exponent) ** 0.5)
    size = F.coalesce(F.octet_length(texts(text)), F.lit(0))
    scanned, own = docs.where(size < limit), fresh(docs, "_scan")
    scanned = scanned.withColumn(own, _scan(shortest, exponent)(texts(text)))
    scanned = scanned.withColumns({names["n_words"]: F.col(own).n, names["runs"]: F.col(own).runs, names["collapsed"]: F.col(own).kept.cast("string")}).drop(own)
    both = scanned.unionByName(_long(docs.where(size >= limit), text, names, shortest, exponent))
    return both.drop(*names).withColumnsRenamed({v: k for k, v in names.items()})


def longest(runs: Column) -> Column:
    """The run of the greatest length, ties by smallest start, then period; null if there is none."""
    order = F.transform(runs, lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period")))
    best = F.array_max(order)
    return F.when(F.size(runs) > 0, F.struct((-best.start).alias("start"), best.length.alias("length"), (-best.period).alias("period")))


def planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with a tenth of its texts made periodic from some word on, by a rule of doc_id: op11's input."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return docs.withColumn(text, F.when((h % 10 == 0) & F.col(text).rlike(r"[^\x20\x09-\x0D]"), made).otherwise(F.col(text)))
