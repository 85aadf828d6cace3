"""Token counts of flat token files by a separator scan.

A flat file is a run of fixed-width token identifiers, documents one after another, each ended by the end-of-document
identifier; nothing says where documents begin. Files are read in blocks. A vectorised search finds the
separators of each block; documents that lie in several blocks are stitched by a prefix scan over the blocks'
summaries, in two levels, so that no task sees the blocks of a whole file.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, prepare, texts, written

#: Bytes of a block, and blocks of a run (the first level of the scan).
BLOCK_BYTES, RUN = 1 << 20, 512
#: Vocabulary of the query, and the identifier that it leaves free for ends of documents.
VOCABULARY, END = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROWS_A_FILE = 50_000


def encoder(vocabulary: str):
    """The byte-pair encoding of a file of ranks."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ordinate", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", out: str = "tokens") -> DataFrame:
    """docs with the little-endian 16-bit identifiers of the text; a null text has none. Each executor has the file."""
    prepare(docs.sparkSession)
    state: dict = {}

    @F.arrow_udf("binary")
    def encode(column: pa.Array) -> pa.Array:
        if "encoder" not in state:
            state["encoder"] = encoder(vocabulary)
        run = state["encoder"].encode_ordinary
        return pa.array([np.array(run(x.decode("utf-8", "replace")), "<u2").tobytes() if x else b"" for x in column.to_pylist()], pa.binary())

    return docs.withColumn(out, encode(texts(text)))


def write_flat(tokens: DataFrame, path: str, column: str = "tokens", end: int = END) -> None:
    """Flat files of the rows' 16-bit identifiers at path: the text writer ends each row with the identifier end.

    end must be the code of a character of UTF-16 (no surrogate), and no token.
    """
    row = F.coalesce(F.col(column), F.lit(b"")).cast("string").alias("value")
    options = {"encoding": "UTF-16LE", "lineSep": chr(end), "maxRecordsPerFile": ROWS_A_FILE}
    tokens.select(row).write.options(**options).text(path)


def read_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, data): the files at path cut into blocks. A file is read whole first, so keep files under 1 GB."""
    files = spark.read.format("binaryFile").load(path)
    starts = F.when(F.col("length") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(block_bytes).cast("bigint")))
    cut = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "content", F.explode(starts).alias("start"))
    return cut.select("file", (F.col("start") / block_bytes).cast("bigint").alias("block"), F.substring("content", (F.col("start") + 1).cast("int"), F.lit(block_bytes)).alias("data"))


def _summaries(width: int, end: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {k: [] for k in _SUMMARY.names}
            for file, block, data in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "data"))):
                ids = np.frombuffer(data, f"<u{width}", len(data) // width)
                at = np.flatnonzero(ids == end)
                found = len(at) > 0
                inner = (np.diff(at) - 1).tolist() if found else []
                for k, v in zip(rows, (file, block, block // RUN, len(ids), len(at), int(at[0]) if found else 0, int(len(ids) - at[-1] - 1) if found else len(ids), inner)):
                    rows[k].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=_SUMMARY)

    return scan


_SUMMARY = pa.schema(
    [("file", pa.string())]
    + [(c, pa.int64()) for c in ("block", "run", "size", "ends", "head", "tail")]
    + [("inner", pa.list_(pa.int64()))]
)


def counts(blocks: DataFrame, width: int = 2, end: int = END) -> DataFrame:
    """(file, doc_no, n_tokens) for each document of the blocks(file, block, data) of flat files, from 0 in each file.

    width: bytes of an identifier. Separators aren't counted, and two of them in a row enclose a document of 0 tokens.
    Tokens after a file's last separator are a last document; bytes that fill no identifier there are left out. Empty
    files have no documents. block_bytes must be a multiple of width, and file names unique.
    """
    sums = written(blocks.mapInArrow(_summaries(width, end), "file string, block bigint, run bigint, size bigint, ends bigint, head bigint, tail bigint, inner array<bigint>"), "scan")
    # A block or run as an element of the scan: its separators, and the tokens after its last one (all, if it has none).
    inside = Window.partitionBy("file", "run").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    # The tokens open before a block: those after the last block with a separator, that block's tail included.
    last_end = F.max(F.when(F.col("ends") > 0, F.col("block"))).over(before)
    so_far = F.coalesce(F.sum("tail").over(before), F.lit(0))
    blocks_ = sums.withColumns({"ends_before": F.coalesce(F.sum("ends").over(before), F.lit(0)), "all_before": so_far, "last_end": last_end})
    at_end = F.when(F.col("ends") > 0, F.col("all_before"))
    blocks_ = blocks_.withColumn("base", F.coalesce(F.max(at_end).over(before), F.lit(0)))
    # all_before sums tails, so what is open is all_before less its value at the last block with a separator.
    blocks_ = blocks_.withColumn("open", F.col("all_before") - F.col("base"))
    runs = sums.groupBy("file", "run").agg(
        F.sum("ends").alias("ends"), F.max_by("tail", F.when(F.col("ends") > 0, F.col("block"))).alias("last_tail"), F.max(F.when(F.col("ends") > 0, F.col("block"))).alias("last"), F.sum("size").alias("size")
    )
    tails = sums.join(runs.select(F.col("file").alias("f"), F.col("run").alias("r"), "last"), (F.col("file") == F.col("f")) & (F.col("run") == F.col("r")))
    tails = tails.groupBy("file", "run").agg(F.sum(F.when(F.col("last").isNull() | (F.col("block") >= F.col("last")), F.col("tail")).otherwise(0)).alias("tail"))
    runs = runs.join(tails, ["file", "run"]).select("file", "run", "ends", "tail")
    over = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"run_ends": F.coalesce(F.sum("ends").over(over), F.lit(0)), "all_runs": F.coalesce(F.sum("tail").over(over), F.lit(0))})
    runs = runs.withColumn("run_open", F.col("all_runs") - F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("all_runs"))).over(over), F.lit(0)))
    whole = blocks_.join(runs.select("file", "run", "run_ends", "run_open"), ["file", "run"])
    opened = F.col("open") + F.when(F.col("last_end").isNull(), F.col("run_open")).otherwise(0)
    first = F.array(opened + F.col("head"))
    ended = whole.where("ends > 0").select("file", (F.col("run_ends") + F.col("ends_before")).alias("from"), F.posexplode(F.concat(first, F.col("inner"))).alias("k", "n_tokens"))
    ended = ended.select("file", (F.col("from") + F.col("k")).alias("doc_no"), "n_tokens")
    closing = runs.groupBy("file").agg(F.sum("ends").alias("doc_no"), F.max("run").alias("last_run"))
    rest = runs.join(closing, "file").where("run = last_run").select("file", "doc_no", (F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("tail") + F.col("run_open"))).alias("n_tokens"))
    return ended.union(rest.where("n_tokens > 0"))


def document_counts(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """(doc_id, file, doc_no, n_tokens): docs tokenised, written as flat files, and counted again by their separators.

    A flat file has no ids. Which document is which follows from the order of writing: docs must be a plain scan (a table), whose rows
    come to the same tasks in the same order again; a document without its count fails the job. A null or empty text is a
    document of 0 tokens; repeated rows are documents of their own; texts of any length are counted whole; an empty table gives none.
    """
    path = new_path(docs.sparkSession, "flat")
    write_flat(encoded(docs.select("text"), vocabulary), path, end=end)
    part, nth = (F.regexp_extract("file", r"^part-(\d+)-.*-c(\d+)\.[^.]*$", k).cast("bigint") for k in (1, 2))
    found = counts(read_blocks(docs.sparkSession, path), end=end)
    found = found.select(part.alias("part"), (nth * ROWS_A_FILE + F.col("doc_no")).alias("row"), "n_tokens")
    at = F.monotonically_increasing_id()
    ids = docs.select("doc_id", F.shiftright(at, 33).alias("file"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("doc_no"))
    both = ids.join(found, (F.col("file") == F.col("part")) & (F.col("doc_no") == F.col("row")), "left")
    counted = F.when(F.col("n_tokens").isNull(), F.raise_error(F.lit("a document without a count")).cast("bigint")).otherwise(F.col("n_tokens"))
    return both.select("doc_id", "file", "doc_no", counted.alias("n_tokens"))
