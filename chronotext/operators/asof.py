"""Attributes as they were known when an event happened (bitemporal point-in-time join)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.skew import salted_join

#: Width of a time bucket in days. Intervals are repeated once for each bucket that they touch.
BUCKET_DAYS = 128


def _bucket(day: Column, width: int) -> Column:
    return F.floor(F.unix_date(day) / width).cast("int")


def known_intervals(
    attributes: DataFrame, *, row_id: Column, series: Column, entity: Column, published: Column, valid_from: Column, valid_to: Column
) -> DataFrame:
    """``entity``, ``row_id``, ``published``, ``valid_from`` and the days ``start`` (in) to ``stop`` (out, null: open) on which each row was both known and valid.

    A row of a ``series`` (one source, restated now and then) is known from its own publication to the next one in the
    series. Days without rows yield nothing. Rows with a null series, entity, publication or start are never known, but a
    restatement with a null ``valid_from`` still ends what it restates. Of several rows of a series published on one day
    the one with the highest ``row_id`` counts; repeated rows count once. The result has at most one row a series and day.
    """
    rows = attributes.select(
        series.alias("series"), entity.alias("entity"), published.alias("published"),
        F.struct(row_id.alias("row_id"), valid_from.alias("valid_from"), valid_to.alias("valid_to")).alias("row"),
    ).where("series IS NOT NULL AND entity IS NOT NULL AND published IS NOT NULL")
    # One row a series and day, so that the window below sees no more rows of a series than there are days.
    daily = rows.groupBy("series", "entity", "published").agg(F.max("row").alias("row"))
    later = F.lead("published").over(Window.partitionBy("series").orderBy("published"))
    return (
        daily.select("entity", "published", "row.*", later.alias("restated"))
        .select(
            "entity", "row_id", "published", "valid_from",
            F.greatest("published", "valid_from").alias("start"), F.least("restated", "valid_to").alias("stop"),
        )
        .where("valid_from IS NOT NULL AND row_id IS NOT NULL AND (stop IS NULL OR start < stop)")
    )


def attributes_as_known(
    events: DataFrame, intervals: DataFrame, *, event_id: Column, entity: Column, at: Column, bucket_days: int = BUCKET_DAYS
) -> DataFrame:
    """``event_id``, ``row_id``: for each event the row of ``known_intervals`` that held for its entity at that time.

    Intervals are exploded into those buckets of ``bucket_days`` in which their entity has events (so neither open intervals nor odd
    dates multiply them), events are joined to them by entity and bucket, and a residual test keeps start <= at < stop. Of several rows the one with the latest ``valid_from``
    wins, then the latest published, then the highest ``row_id``. Events without a row, entity or time are left out;
    repeated events give one row. Entities with many events are spread over tasks (``salted_join``); an entity has
    no more intervals a bucket than series times days.
    """
    asked = (
        events.select(event_id.alias("event_id"), entity.alias("entity"), at.alias("at"))
        .where("event_id IS NOT NULL AND entity IS NOT NULL AND at IS NOT NULL")
        .distinct()
        .withColumn("bucket", _bucket(F.col("at"), bucket_days))
    )
    # As many numbers an entity as the calendar has buckets, at most.
    visited = asked.groupBy("entity").agg(F.collect_set("bucket").alias("buckets"))
    first, last = _bucket(F.col("start"), bucket_days), _bucket(F.date_sub("stop", 1), bucket_days)
    touched = F.filter("buckets", lambda b: (b >= F.col("first")) & (F.col("last").isNull() | (b <= F.col("last"))))
    held = intervals.withColumns({"first": first, "last": last}).join(visited, "entity").withColumn("bucket", F.explode(touched)).drop("first", "last", "buckets")
    matched = salted_join(asked, held, ["entity", "bucket"], F.col("event_id")).where("start <= at AND (stop IS NULL OR at < stop)")
    best = F.max(F.struct("valid_from", "published", "row_id"))
    return matched.groupBy("event_id", "at", "entity").agg(best.alias("best")).select("event_id", F.col("best.row_id").alias("row_id")).distinct()
