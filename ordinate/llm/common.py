"""What the operators of this subpackage share: scratch tables, small sides of joins, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that is broadcast at most; larger sides are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bits of the bitmap of flagged() at most: 32 MB are broadcast, however many keys there are.
BITMAP_BITS = 1 << 28
#: Rows and bytes of an Arrow batch: long texts travel in batches of bounded size.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session, so that a batch of long texts fits a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    held = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < held <= ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def scratch(spark: SparkSession) -> str:
    """The folder that the cluster shares; one of this machine only where none is named and all work is on it (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.gettempdir()}/ordinate-scratch"
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/ordinate"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """df as a written table of the shared folder: lineage ends here, and a lost executor costs nothing of it.

    group_bytes: of a row group, about, for tables of large rows. Spark decodes up to 4096 rows of a row group at a time, and the writer by itself
    looks at sizes every 100 rows only.
    """
    path = new_path(df.sparkSession, name)
    bounds = {"parquet.block.size": group_bytes, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1} if group_bytes else {}
    df.write.options(compression="zstd", **bounds).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes written() tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_scratch_path", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with the broadcast hint if it has limit rows at most (narrow rows are meant); without it, Spark shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def flagged(df: DataFrame, key: Column, ids: DataFrame, out: str) -> DataFrame:
    """df with a boolean column out: true for each row whose key is in the one column of ids, false for nearly all others.

    A bitmap of the keys' hashes, of BITMAP_BITS at most, is broadcast: rows that can't have a partner need not be shuffled
    to find that out. The more keys there are, the more rows without a partner are flagged, too; a join must follow.
    """
    bits = max(1 << 15, min(BITMAP_BITS, 1 << (8 * ids.count()).bit_length()))
    bucket, held = fresh(df, "_bucket"), fresh(df, "_bits")
    place = lambda c: F.pmod(F.xxhash64(c.cast("bigint")), F.lit(bits)) + 1
    placed = ids.select(place(F.col(ids.columns[0])).alias("p"))
    bitmap = placed.groupBy(F.bitmap_bucket_number("p").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(held))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring(F.col(held), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    found = df.join(F.broadcast(bitmap), F.bitmap_bucket_number(place(key)) == F.col(bucket), "left")
    return found.withColumn(out, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop(bucket, held)


def fresh(df: DataFrame, stem: str) -> str:
    """stem, with as many underscores after it as no column of df needs to begin with it, whatever its case."""
    while any(c.lower().startswith(stem.lower()) for c in df.columns):
        stem += "_"
    return stem


def texts(column: str = "text"):
    """The UTF-8 bytes of a text column: words are taken from bytes, without decoding."""
    return F.col(column).cast("string").cast("binary")


def release() -> None:
    """Gives freed memory back to the system: Python workers live on, and what one stage freed would count beside what the next one takes."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable) -> Callable:
    """A function of batches that releases memory when it ends."""

    def of_batches(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return of_batches


def released_table(run: Callable) -> Callable:
    """The same for a function of a table."""

    def of_table(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release()

    return of_table


def flat_list(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array whose lists have the given lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose binary column holds about most_bytes at most (one row at least)."""
    for batch in batches:
        sizes = np.cumsum([len(x) if (x := v.as_buffer()) is not None else 0 for v in batch.column(column)])
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + most_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to
