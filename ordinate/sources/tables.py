"""The fixture tables in the roles that the operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import TensorFrame
from ..errors import ShapeError
from ..operators.sequence import positions, with_previous

#: Microseconds of a day; rows of a user between which the row before is looked up by a window.
DAY, CHUNK_ROWS = 86_400_000_000, 4096


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, t, event_id, x, dt): each user's events in order of time; dt: hours since the one before, 0 at first."""
    return sequenced(read(spark, sf_dir, "events"))


def sequenced(events: DataFrame) -> DataFrame:
    """Events numbered by user and day, so that a user of any number of events is many tasks."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select("user_id", "event_id", F.col("value").alias("x"), at.alias("at"))
    rows = positions(rows, ["user_id"], ["at", "event_id"], parts=F.floor(F.col("at") / DAY))
    rows = with_previous(rows, ["user_id"], "t", {"last": "at"}, CHUNK_ROWS)
    hours = (F.col("at") - F.col("last")) / 3.6e9
    return rows.select("user_id", "t", "event_id", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce(hours, F.lit(0.0)).alias("dt"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, x): embeddings as arrays of doubles."""
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def vector_tensor(spark: SparkSession, sf_dir: str) -> TensorFrame:
    """Embeddings as [vectors, dimension] by their ids, which must count from 0 without gaps."""
    rows = vectors(spark, sf_dir)
    n, ids, top, least, dim = rows.agg(F.count("*"), F.countDistinct("vec_id"), F.max("vec_id"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if n != ids or n != (top if top is not None else -1) + 1 or least != dim:
        raise ShapeError(f"{n} vectors with {ids} ids up to {top}, of {least} to {dim} values")
    return TensorFrame.from_rows(rows, ["vec_id"], "x", (n, dim))


def centroids(spark: SparkSession, sf_dir: str) -> TensorFrame:
    """[labels, 64]: the mean vector of each label."""
    spread = vectors(spark, sf_dir).select("label", F.posexplode("x").alias("d", "v"))
    means = spread.groupBy("label", "d").agg(F.avg("v").alias("v"))
    labels, top, dim = means.agg(F.countDistinct("label"), F.max("label"), F.max("d") + 1).first()
    if labels != top + 1:
        raise ShapeError(f"{labels} labels up to {top}")
    return TensorFrame.of(means, ["label", "d"], "v", (labels, dim))
