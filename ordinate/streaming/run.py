"""Running streams to their end, and tables that cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares; in one of this machine only where none is named and all work is on it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/ordinate-scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/ordinate/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df as a written table."""
    path = shared_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def to_table(stream: DataFrame) -> DataFrame:
    """What a stream yields from all that is there now, as a table of its file sink."""
    spark = stream.sparkSession
    path = shared_path(spark, "stream")
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start(path)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
