"""Content addresses, fingerprints, caches and resumable work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.skew import row_numbers


def content_hash(text: Column) -> Column:
    """``sha256:`` and the digest of the UTF-8 text."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def line(*columns: Column) -> Column:
    """One line a row; a null is printed as None."""
    return F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("None")) for c in columns])


def fingerprint(rows: DataFrame, by: Sequence[str], text: Column) -> DataFrame:
    """``by``, ``rows``, ``fingerprint``: equal for equal multisets of lines, whatever their order.

    The eight 32-bit words of the lines' SHA-256 are added up, each for itself, and the count and sums hashed once more: sums
    are combined before the shuffle, so no task holds the lines of a group. It tells accidental differences, not forged ones.
    """
    digest = rows.select(*by, F.sha2(text, 256).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"s{i}") for i in range(8)]
    sums = digest.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *words)
    return sums.select(*by, "rows", F.sha2(F.concat_ws(" ", F.col("rows").cast("string"), *[f"s{i}" for i in range(8)]), 256).alias("fingerprint"))


def ordered_fingerprint(rows: DataFrame, order: Sequence[str], text: Column) -> str:
    """``fingerprint`` of all lines each with its place in the total ``order``: equal only for equal lists."""
    placed = row_numbers(rows.select(*order, text.alias("_line")), order, "_place")
    return fingerprint(placed, [], line(F.col("_place"), F.col("_line"))).first()["fingerprint"]


def cache_misses(wanted: DataFrame, cache: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``wanted`` that the cache lacks."""
    return wanted.select(*keys).distinct().join(cache.select(*keys), list(keys), "left_anti")


def insert_ignore(cache: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cache with those new rows whose key it lacks, one a key."""
    return cache.unionByName(new.dropDuplicates(list(keys)).join(cache.select(*keys), list(keys), "left_anti"))


def remaining(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Tasks without a stored result: what a resumed run has still to do."""
    return tasks.join(done.select(key), key, "left_anti")


def reuse(target: DataFrame, earlier: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """``by``, ``n``, ``fresh``: distinct content hashes of each target and those that no earlier one has."""
    seen = earlier.select(F.col(key)).distinct().withColumn("_seen", F.lit(True))
    rows = target.select(*by, key).distinct().join(seen, key, "left")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_seen").isNull(), 1)).alias("fresh"))


def repeatable(runs: DataFrame, by: Sequence[str], output: str) -> DataFrame:
    """``by``, ``runs``, ``outputs``, ``same``: whether all runs of one prompt gave the same output (by digest; a null is an output of its own)."""
    digest = F.coalesce(F.sha2(F.col(output), 256), F.lit("None"))
    rows = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.countDistinct(digest).alias("outputs"))
    return rows.withColumn("same", F.col("outputs") == 1)


def same_as_control(runs: DataFrame, control: DataFrame, by: Sequence[str], nth: str, output: str, repeat: int = 2) -> DataFrame:
    """``prompts``, ``same``: how many prompts of ``runs`` gave in their first run (``nth`` = 1) what ``control`` gave in run ``repeat``. Prompts that only one has aren't compared."""
    digest = F.coalesce(F.sha2(F.col(output), 256), F.lit("None"))
    first = runs.where(F.col(nth) == 1).select(*by, digest.alias("_a"))
    other = control.where(F.col(nth) == repeat).select(*by, digest.alias("_b"))
    return first.join(other, list(by)).agg(F.count(F.lit(1)).alias("prompts"), F.count(F.when(F.col("_a") == F.col("_b"), 1)).alias("same"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, seed: int, n: int) -> DataFrame:
    """``n`` rows a stratum (a null one included), the first by the digest of seed and key: the same rows on every run, however they are partitioned."""
    order = Window.partitionBy(stratum).orderBy(F.sha2(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")), 256), key)
    return rows.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= n)
