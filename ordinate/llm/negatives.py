"""Hard-negative mining by blocked dense matrix products.

Vectors are packed in blocks, and those of the anchors in blocks of their own. As many of these as have ANCHOR_BYTES at most are
broadcast at a time and multiplied with all blocks of candidates, in double precision, which is exact for integers below 2^53. A first pass keeps
each anchor's best positives of a task, which merge; a second one the best negatives within the window of each positive's score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, fresh, new_path, prepare, written

#: What is kept of an anchor and of a positive; a negative's score in hundredths of the positive's, at least and at most.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Bytes of a block of anchors, which is broadcast, and of a block of candidates; vectors of a block; anchors multiplied at once.
ANCHOR_BYTES, BLOCK_BYTES, BLOCK_ROWS, TILE = 32 << 20, 4 << 20, 4096, 512

_PACKED = pa.schema([("block", pa.int64()), ("dim", pa.int64()), ("rows", pa.binary()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("anchors", pa.binary()), ("vectors", pa.binary())])
_PACKED_SQL = "block bigint, dim bigint, rows binary, ids array<bigint>, labels array<string>, anchors binary, vectors binary"
_FOUND = "anchor bigint, slot bigint, score bigint, id bigint"


class Packed:
    """A block's columns; rows are numbers that no other row has."""

    def __init__(self, row: dict) -> None:
        self.rows = np.frombuffer(row["rows"], np.int64)
        self.known = np.array([i is not None for i in row["ids"]], bool)
        self.ids = np.array([i or 0 for i in row["ids"]], np.int64)
        self.labels = row["labels"]
        self.anchors = np.frombuffer(row["anchors"], bool)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(self.rows), row["dim"])
        self.peak = np.abs(self.vectors).max(initial=0)

    def coded(self, codes: dict[str, int]) -> np.ndarray:
        """The labels' numbers; -1 for labels that codes lacks."""
        return np.array([codes.get(x, -1) for x in self.labels], np.int64)


def _pack(most_bytes: int, most_rows: int, only: bool):
    """Rows (dim, id, label, anchor, vector), or blocks of which only the anchors are taken, in blocks of one dim."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks, count = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def cut() -> pa.RecordBatch:
            nonlocal blocks, held
            rows, ids, labels, anchors, vectors = zip(*held)
            out = {"block": part << 32 | blocks, "dim": len(vectors[0]), "rows": np.array(rows, np.int64).tobytes(), "ids": ids, "labels": labels}
            out |= {"anchors": np.array(anchors, bool).tobytes(), "vectors": np.array(vectors, np.float64).tobytes()}
            blocks, held = blocks + 1, []
            return pa.RecordBatch.from_pylist([out], schema=_PACKED)

        for batch in batches:
            lists = batch.column("vector")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *lists.value_lengths().to_pylist()])
            names = ("row", "id", "label", "anchor") if only else ("id", "label", "anchor")
            for k, values in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
                vector = flat[ends[k] : ends[k + 1]]
                if held and (len(vector) != len(held[0][4]) or len(held) >= most_rows or (len(held) + 1) * vector.nbytes > most_bytes):
                    yield cut()
                held.append((*values, vector) if only else (part << 32 | count, *values, vector))
                count += 1
        if held:
            yield cut()

    return run


def _anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            block = Packed(r)
            at = np.flatnonzero(block.anchors).tolist()
            if at:
                columns = [[r["dim"]] * len(at), block.rows[at], [r["ids"][k] for k in at], [r["labels"][k] for k in at], [True] * len(at), list(block.vectors[at])]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["dim", "row", "id", "label", "anchor", "vector"])


class Best:
    """The best of each slot: higher scores first, then smaller ids, unknown ones last."""

    def __init__(self, slots: int, most: int) -> None:
        self.score = np.full((slots, most), -np.inf)
        self.id, self.known = np.zeros((slots, most), np.int64), np.zeros((slots, most), bool)

    def least(self) -> np.ndarray:
        """What a score must reach to be among a slot's best."""
        return self.score[:, -1]

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        if not len(slot):
            return
        most, touched = self.score.shape[1], np.unique(slot)
        slot = np.concatenate([np.repeat(touched, most), slot])
        score, ids, known = (np.concatenate([old[touched].ravel(), new]) for old, new in ((self.score, score), (self.id, ids), (self.known, known)))
        order = np.lexsort((ids, ~known, -score, slot))
        slot, score, ids, known = slot[order], score[order], ids[order], known[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        top = rank < most
        for held, new in ((self.score, score), (self.id, ids), (self.known, known)):
            held[slot[top], rank[top]] = new[top]

    def batch(self, rows: np.ndarray, slots_a_row: int) -> pa.RecordBatch:
        slot, rank = np.nonzero(self.score > -np.inf)
        columns = [pa.array(rows[slot // slots_a_row]), pa.array(slot % slots_a_row), pa.array(self.score[slot, rank].astype(np.int64)), pa.array(self.id[slot, rank], mask=~self.known[slot, rank])]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "slot", "score", "id"])


def _product(a: np.ndarray, b: np.ndarray, peaks: float) -> np.ndarray:
    if peaks * a.shape[1] >= 2.0**53:
        raise ValueError("inner products of 2^53 or more would not be exact in double precision")
    return a @ b.T


def _positives(sent, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Packed(sent.value)
        codes = {x: k for k, x in enumerate(sorted(set(anchors.labels)))}
        own = anchors.coded(codes)
        best = Best(len(own), most)
        for batch in batches:
            for r in batch.to_pylist():
                block = Packed(r)
                theirs = block.coded(codes)
                for code in np.unique(theirs[theirs >= 0]).tolist():
                    of, at = np.flatnonzero(own == code), np.flatnonzero(theirs == code)
                    for k in range(0, len(of), TILE):
                        rows = of[k : k + TILE]
                        score = _product(anchors.vectors[rows], block.vectors[at], anchors.peak * block.peak)
                        _, i, j = np.intersect1d(anchors.rows[rows], block.rows[at], assume_unique=True, return_indices=True)
                        score[i, j] = -np.inf  # an anchor is not its own positive
                        enough = best.least()[rows]
                        if score.shape[1] > most:
                            enough = np.maximum(enough, np.partition(score, -most, axis=1)[:, -most])
                        i, j = np.nonzero((score >= enough[:, None]) & (score > -np.inf))
                        best.offer(rows[i], score[i, j], block.ids[at][j], block.known[at][j])
        yield best.batch(anchors.rows, 1)

    return run


def _negatives(sent, most: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, scores = sent.value
        anchors = Packed(row)
        codes = {x: k for k, x in enumerate(sorted(set(anchors.labels)))}
        own, slots = anchors.coded(codes), scores.shape[1]
        given = scores > np.iinfo(np.int64).min
        whole = np.where(given, scores, 0)
        least, greatest = -((-low * whole) // 100), (high * whole) // 100
        least, greatest = np.where(given, least, np.inf), np.where(given, greatest, -np.inf)
        best = Best(len(own) * slots, most)
        for batch in batches:
            for r in batch.to_pylist():
                block = Packed(r)
                theirs = block.coded(codes)
                for k in range(0, len(own), TILE):
                    to = min(k + TILE, len(own))
                    score = _product(anchors.vectors[k:to], block.vectors, anchors.peak * block.peak)
                    enough = np.maximum(least[k:to], best.least().reshape(-1, slots)[k:to])
                    i, j = np.nonzero((score >= enough.min(1)[:, None]) & (score <= greatest[k:to].max(1)[:, None]) & (own[k:to, None] != theirs))
                    found = score[i, j]
                    for s in range(slots):
                        fits = (found >= enough[i, s]) & (found <= greatest[k:to][i, s])
                        best.offer((k + i[fits]) * slots + s, found[fits], block.ids[j[fits]], block.known[j[fits]])
        yield best.batch(anchors.rows, slots)

    return run


def _rounds(asked: DataFrame) -> list[list[int]]:
    """The blocks of each round: of one dim, ANCHOR_BYTES of vectors at most. A line for each block comes to the driver."""
    rounds, dim, size = [], None, 0
    for r in asked.select("block", "dim", F.octet_length("vectors").alias("size")).orderBy("dim", "block").collect():
        if not rounds or r["dim"] != dim or size + r["size"] > ANCHOR_BYTES:
            rounds.append([])
            dim, size = r["dim"], 0
        rounds[-1].append(r["block"])
        size += r["size"]
    return rounds


def _joined(blocks: list[dict]) -> dict:
    """Packed blocks as one."""
    out = {"dim": blocks[0]["dim"]} | {c: b"".join(b[c] for b in blocks) for c in ("rows", "anchors", "vectors")}
    return out | {c: [v for b in blocks for v in b[c]] for c in ("ids", "labels")}


def _merged(found: DataFrame, most: int) -> DataFrame:
    """The best of all tasks' best, with their rank."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(
    vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the negatives of each anchor and positive.

    vectors hold integers; anchor says which rows are anchors. A score is an inner product. An anchor's positives are the first rows of its label
    other than itself, by descending score, then vec_id; negatives the first of other labels with low * positive_score <= 100 * negative_score
    <= high * positive_score. Rows with a null label or vector, or a null or non-finite component, take no part; rows without vec_id do, after
    others of the same score. Repeated rows are rows of their own, and vectors of different lengths never meet. An anchor without positives, and a
    positive without negatives, gives no row; an empty table gives an empty table. Other columns are not read. Scores that double precision can't
    hold exactly fail the job.
    """
    spark = vectors.sparkSession
    prepare(spark)
    marked = fresh(vectors, "_anchor")
    usable = F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.withColumn(marked, F.coalesce(anchor, F.lit(False))).where(usable).select(
        F.size(vector).cast("bigint").alias("dim"), F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"),
        F.col(marked).alias("anchor"), F.col(vector).cast("array<double>").alias("vector"),
    )
    rows = rows.sortWithinPartitions("dim", "label")
    blocks = written(rows.mapInArrow(_pack(BLOCK_BYTES, BLOCK_ROWS, False), _PACKED_SQL), "blocks")
    taken = written(blocks.mapInArrow(_anchors_of, "dim bigint, row bigint, id bigint, label string, anchor boolean, vector array<double>"), "anchors")
    size = taken.agg(F.sum(8 * F.col("dim") + 64)).first()[0] or 0
    order = ["dim", "label", "row"]
    dealt = taken.repartitionByRange(1 + size // ANCHOR_BYTES, *order).sortWithinPartitions(*order)
    asked = written(dealt.mapInArrow(_pack(ANCHOR_BYTES, ANCHOR_BYTES, True), _PACKED_SQL), "asked")
    path = new_path(spark, "negatives")
    for n, chosen in enumerate(_rounds(asked)):
        row = _joined(asked.where(F.col("block").isin(chosen)).toArrow().to_pylist())  # ANCHOR_BYTES of vectors at most
        own = blocks.where(F.col("dim") == row["dim"])
        sent = spark.sparkContext.broadcast(row)
        best = written(_merged(own.mapInArrow(_positives(sent, positives), _FOUND), positives).drop("slot"), "positives")
        held = best.select("anchor", "rank", "score").toArrow()  # positives a vector of the block
        at = Packed(row).rows
        where = np.argsort(at)
        scores = np.full((len(at), positives), np.iinfo(np.int64).min)
        scores[where[np.searchsorted(at, held["anchor"].to_numpy(), sorter=where)], held["rank"].to_numpy() - 1] = held["score"].to_numpy()
        sent_scores = spark.sparkContext.broadcast((row, scores))
        found = _merged(own.mapInArrow(_negatives(sent_scores, negatives, low, high), _FOUND), negatives)
        found = found.select("anchor", (F.col("slot") + 1).alias("slot"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        named = best.select(F.col("anchor").alias("of"), F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        named = named.join(found, (F.col("of") == F.col("anchor")) & (F.col("nth") == F.col("slot")))
        ids = taken.select(F.col("row"), F.col("id").alias("anchor_id"))
        out = named.join(ids, F.col("row") == F.col("anchor")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        out.write.option("compression", "zstd").parquet(f"{path}/round={n}")
        dropped(best)
        sent.destroy()
        sent_scores.destroy()
    dropped(blocks, taken, asked)
    kind = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return spark.read.schema(f"{kind}, round bigint").parquet(path).drop("round") if size else spark.createDataFrame([], kind)


def integers(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """table with components in 256ths, rounded down, and the labels of a seventh of its rows made wrong: op13's input."""
    moved = F.when(F.col(vec_id) % 7 == 0, (F.col(label) + 1) % 10).otherwise(F.col(label))
    whole = lambda x: F.when(F.abs(x) < float("inf"), F.floor(x * 256).cast("double")).otherwise(x)  # noqa: E731  (NaN is above infinity)
    return table.withColumns({label: moved, vector: F.transform(F.col(vector).cast("array<double>"), whole)})
