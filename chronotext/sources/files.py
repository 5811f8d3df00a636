"""Readers and writers: tables, whole files, JSON snapshots, and idempotent or resumable sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def whole_texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path``, ``text`` of every file below ``path`` whose name matches ``pattern``; one row a file."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return rows.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path``, ``sha1``, ``length``, ``content`` of every file: what an extractor of another format starts from."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select("path", F.sha1("content").alias("sha1"), "length", "content")


def verified(files: DataFrame, pins: DataFrame) -> DataFrame:
    """Files whose SHA-1 is a pinned one (``sha1`` of ``pins``); wrong bytes are never kept."""
    return files.join(pins.select("sha1").distinct(), "sha1", "left_semi")


def json_snapshot(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON document, or one a line, read by a declared schema."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_once(df: DataFrame, path: str) -> None:
    """A snapshot that is never overwritten: fails if ``path`` exists."""
    df.write.mode("errorifexists").json(path)


MANIFEST = ("source_doc", "source_ref", "refs", "kind", "published_at", "valid_from", "valid_to", "content_hash", "tokens")


def write_manifest(chunks: DataFrame, path: str) -> None:
    """What is known of each chunk but its text, as JSON; fails if ``path`` exists."""
    write_once(chunks.select(*MANIFEST), path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """A table with one folder a value of ``by``, replaced as a whole."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def append_missing(new: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append to a parquet table the rows whose keys it lacks; a repeated run adds nothing."""
    if exists(new.sparkSession, path):
        new = new.join(new.sparkSession.read.parquet(path).select(*keys), list(keys), "left_anti")
    new.dropDuplicates(list(keys)).write.mode("append").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``; what keeps that from being known is raised."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def reset_tables(empty: dict[str, DataFrame]) -> None:
    """Replace each table (path: rows to begin with) and leave every other one, caches above all, alone."""
    for path, rows in empty.items():
        rows.limit(0).write.mode("overwrite").parquet(path)
