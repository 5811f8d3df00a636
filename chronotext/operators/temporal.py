"""Validity windows of versions, the as-of filter, and what is stale or missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_force(day: Column, start: Column, stop: Column) -> Column:
    """start <= day < stop; a null ``stop`` is still current, a null ``day`` or ``start`` is never in force (null)."""
    return (start <= day) & (stop.isNull() | (day < stop))


def version_key(version: Column) -> Column:
    """MAJOR.MINOR... as numbers, so that 1.10 sorts after 1.9; a part that is no number is null and sorts first."""
    return F.transform(F.split(version, r"\."), lambda x: x.try_cast("int"))


def validity_windows(versions: DataFrame, by: Sequence[str], version: str, effective: str, printed: str) -> DataFrame:
    """``by``, version, ``valid_from``, ``valid_to``, ``refused``: a version holds until the next one takes effect.

    A version is refused, with the reason and without dates, if its own date is unknown or before its printed date, or if
    its successor's is unknown or not after its own: nothing bridges a gap. The last version stays open.
    One row a version is expected; windows run over the versions of one document.
    """
    order = Window.partitionBy(*by).orderBy(version_key(F.col(version)), version)
    rows = versions.withColumn("_next", F.lead(effective).over(order)).withColumn("_last", F.lead(F.lit(False), 1, True).over(order))
    start, nxt = F.col(effective), F.col("_next")
    refused = (
        F.when(start.isNull(), "effective date unknown")
        .when(start < F.col(printed), "effective before printed date")
        .when(F.col("_last"), F.lit(None))
        .when(nxt.isNull(), "successor date unknown")
        .when(nxt <= start, "successor not after this version")
    )
    rows = rows.withColumn("refused", refused)
    ok = F.col("refused").isNull()
    return rows.select(*by, version, F.when(ok, start).alias("valid_from"), F.when(ok, nxt).alias("valid_to"), "refused")


def windows_by_successor(rows: DataFrame, by: Sequence[str], start: str, tie: str) -> DataFrame:
    """``rows`` with ``valid_until`` (the start of the next row of its key) and ``newer_exists``."""
    order = Window.partitionBy(*by).orderBy(start, tie)
    return rows.withColumn("valid_until", F.lead(start).over(order)).withColumn("newer_exists", F.lead(F.lit(True), 1, False).over(order))


def pending(registered: DataFrame, ingested: DataFrame, by: Sequence[str], version: str) -> DataFrame:
    """Registered versions newer than the newest ingested one of their document (all of them where none is ingested)."""
    newest = ingested.groupBy(*by).agg(F.max(version_key(F.col(version))).alias("_newest"))
    joined = registered.join(newest, list(by), "left")
    return joined.where(F.col("_newest").isNull() | (version_key(F.col(version)) > F.col("_newest"))).select(*by, version).distinct()


def midpoint(start: Column, stop: Column) -> Column:
    """The day halfway through a window, the earlier of two; null for an open window."""
    return F.date_add(start, F.floor(F.datediff(stop, start) / 2).cast("int"))
