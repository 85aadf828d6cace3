"""Lookups by identifiers: joins on a key, and grouped sums back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ShapeError
from ..frame import TensorFrame
from .elemwise import sided


def gather_rows(table: TensorFrame, ids: DataFrame, id_column: str = "id") -> DataFrame:
    """ids with i1 and v of the table's row that each names: a row of ids gives a row for each column of the table.

    An id without a row of the table fails the job that reads it, instead of yielding what is not there.
    """
    if table.rank != 2:
        raise ShapeError("the table of a gather has two axes")
    rows = table.df.select(F.col("i0").alias("_id"), "i1", "v")
    found = ids.join(sided(rows, table.size), ids[id_column] == F.col("_id"), "left")
    wrong = F.raise_error(F.concat(F.lit("no row "), F.coalesce(F.col(id_column).cast("string"), F.lit("null"))))
    return found.withColumn("v", F.when(F.col("_id").isNull(), wrong.cast("double")).otherwise(F.col("v"))).drop("_id")


def scatter_add_rows(grads: DataFrame, rows: int, columns: int, id_column: str = "id") -> TensorFrame:
    """[rows, columns] with the sums of grads(id, i1, v) by id; rows without any are zeros."""
    spark = grads.sparkSession
    sums = grads.groupBy(F.col(id_column).alias("i0"), "i1").agg(F.sum("v").alias("v"))
    outside = F.raise_error(F.concat(F.lit("id over the last row: "), F.col("i0").cast("string")))
    sums = sums.withColumn("v", F.when((F.col("i0") < 0) | (F.col("i0") >= rows), outside.cast("double")).otherwise(F.col("v")))
    zeros = TensorFrame.generated(spark, (rows, columns), lambda *_: F.lit(0.0)).df
    return TensorFrame(zeros.unionByName(sums).groupBy("i0", "i1").agg(F.sum("v").alias("v")), (rows, columns))


def one_hot(ids: TensorFrame, classes: int) -> TensorFrame:
    """A last axis of classes with 1 at the id; all zeros for other ids."""
    spread = ids.df.withColumn("_c", F.explode(F.expr(f"sequence(0L, {classes - 1}L)")))
    df = spread.select(*ids.axes, F.col("_c").alias(f"i{ids.rank}"), (F.col("v") == F.col("_c")).cast("double").alias("v"))
    return TensorFrame(df, ids.shape + (classes,))


def take_along_last(x: TensorFrame, ids: TensorFrame) -> TensorFrame:
    """x at the id of each leading coordinate; the last axis goes."""
    if x.shape[:-1] != ids.shape:
        raise ShapeError(f"ids of {ids.shape} for {x.shape}")
    at = ids.df.select(*[F.col(a).alias(f"_{a}") for a in ids.axes], F.col("v").cast("bigint").alias("_id"))
    on = [F.col(a) == F.col(f"_{a}") for a in ids.axes] + [F.col(f"i{ids.rank}") == F.col("_id")]
    return TensorFrame(x.df.join(sided(at, ids.size), on).select(*ids.axes, "v"), ids.shape)
