"""Incremental forms of the batch operators: an extension, the rest of the library doesn't need it."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.operators.temporal import windows_by_successor
from chronotext.session import shared_dir
from chronotext.sources.files import append_missing


def source(spark: SparkSession, path: str, files_a_trigger: int = 64) -> DataFrame:
    """A folder or file of parquet as a stream, with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    # As a pattern, so that a single file will do as well as a folder.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def hourly(events: DataFrame, at: str, by: Sequence[str], value: str, late: str = "1 day") -> DataFrame:
    """``start``, ``by``, ``n``, ``total``: counts and sums an hour of event time; rows later than the watermark are dropped by the stream."""
    stamped = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return stamped.groupBy(F.window(at, "1 hour").alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def deduplicated(rows: DataFrame, keys: Sequence[str], at: str, late: str = "1 day") -> DataFrame:
    """A stream without rows whose keys came within the watermark before."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def run_once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain a stream into the shared folder and read the result; progress is kept in a checkpoint there."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint")
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:  # each trigger replaces the result
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def upsert_windows(versions: DataFrame, path: str, keys: Sequence[str], by: Sequence[str], start: str, tie: str) -> DataFrame:
    """Drain a stream of versions into the table at ``path`` (one row a key, repeats add nothing) and return its validity windows."""
    spark = versions.sparkSession
    query = (
        versions.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")
        .foreachBatch(lambda df, _: append_missing(df, path, keys)).start()
    )
    query.awaitTermination()
    return windows_by_successor(spark.read.parquet(path), by, start, tie)
