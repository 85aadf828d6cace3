"""Moving ranges of a stream's values, as a quantizer observes them.

After batches 1 to n the range is (1 - m) * (range before) + m * (range of the batch), that of the first batch being taken as it is. As a pair (decay, sum),
a batch is (1 - m, m * range), and pairs combine from left to right by (d1 * d2, s1 * d2 + s2), whatever the brackets. So each batch writes
its own pair, under its number, and the pairs of all batches are combined when they are asked for: a batch that runs again writes the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import ConfigError
from .run import shared_path

PAIRS = "low double, high double"


def observe(stream: DataFrame, value: str, path: str, log: str) -> StreamingQuery:
    """Starts to write the range of each batch of a stream at path/batch=number; batches without numbers write nothing. log is its checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        v = F.col(value).cast("double")
        own = batch.where(v.isNotNull() & ~F.isnan(v)).agg(F.min(v).alias("low"), F.max(v).alias("high")).where("low IS NOT NULL")
        own.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start()


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(batch, low, high) of what observe() has written: a row a batch."""
    return spark.read.schema(f"{PAIRS}, batch bigint").parquet(path)


def moving(batches: DataFrame, momentum: float = 0.01) -> DataFrame:
    """(low, high, batches): the moving range after all batches(batch, low, high). No batches give no row."""
    if not 0 <= momentum <= 1:
        raise ConfigError(f"momentum {momentum}")
    # A row a batch: as small as the stream's log, so that one task can number it.
    numbered = batches.select("low", "high", F.row_number().over(Window.orderBy("batch")).alias("_i"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("_n"))
    share = F.when(F.col("_i") == 1, 1.0).otherwise(momentum) * F.pow(F.lit(1.0 - momentum), F.col("_n") - F.col("_i"))
    out = numbered.agg(F.sum(F.col("low") * share).alias("low"), F.sum(F.col("high") * share).alias("high"), F.count("*").alias("batches"))
    return out.where("batches > 0")


def observed_in_parts(parts: list[DataFrame], value: str, momentum: float = 0.01) -> DataFrame:
    """moving() of a stream that gets the parts one after another, and is stopped in between."""
    spark = parts[0].sparkSession
    path = shared_path(spark, "ranges")
    for part in parts:
        part.write.mode("append").parquet(f"{path}-in")
        observe(spark.readStream.schema(part.schema).parquet(f"{path}-in"), value, path, f"{path}-log").awaitTermination()
    return moving(pairs(spark, path), momentum)
