"""Joins that survive a key which holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.session import materialize

#: A key is hot when it has more rows than a task's fair share; below this many rows none is.
MIN_HOT_ROWS = 20_000
#: Fair shares per shuffle partition. It bounds the table of hot keys: at most PARTS * SHARES rows can exceed total / (PARTS * SHARES).
SHARES = 4


def hot_keys(rows: DataFrame, on: Sequence[str], min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """``on`` and ``_salts`` (>= 2) of each hot key. Never more than ``SHARES * shuffle partitions`` rows, so it may be broadcast."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    fair = rows.agg((F.count(F.lit(1)) / (parts * SHARES)).alias("_fair")).scalar()
    limit = F.greatest(F.lit(float(min_rows)), fair)
    return sizes.where(F.col("_n") > limit).select(*on, F.ceil(F.col("_n") / limit).cast("int").alias("_salts"))


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], spread: Column, how: str = "inner", min_rows: int = MIN_HOT_ROWS,
    sizes_of: DataFrame | None = None, hot: DataFrame | None = None,
) -> DataFrame:
    """``left JOIN right USING (on)`` where ``left`` may have hot keys and ``right`` has few rows a key.

    The left rows of a hot key are spread over ``_salts`` tasks by the hash of ``spread`` (a column that differs between
    them), and only for those keys are the right rows repeated. ``how`` is inner, left or left_anti/left_semi.
    The hot keys are found first, in a job of
    their own; without any the join is a plain one. ``sizes_of``: the rows whose keys are counted, where the left ones are dear to make and another table tells as much;
    ``hot``: the stored ``hot_keys``, where they are known.
    """
    on = list(on)
    hot = materialize(hot_keys(left if sizes_of is None else sizes_of, on, min_rows)) if hot is None else hot
    if hot.isEmpty():
        return left.join(right, on, how)
    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"))
    salted = left.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_salts")
    repeated = (
        right.join(F.broadcast(hot), on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def grid_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], spread_left: Column, spread_right: Column, min_rows: int = MIN_HOT_ROWS,
    sizes_of: DataFrame | None = None, hot: DataFrame | None = None,
) -> DataFrame:
    """``left JOIN right USING (on)`` where a key may be hot on both sides.

    The rows of a hot key form a grid: left rows are cut into ``_salts`` rows of it, right rows into as many columns, and each of
    its cells is a key of its own, so that no task meets more than a fair share of either side. ``sizes_of`` and ``hot`` are as in ``salted_join``;
    the first should count both sides where the left one doesn't tell about the right.
    """
    on = list(on)
    hot = materialize(hot_keys(left if sizes_of is None else sizes_of, on, min_rows)) if hot is None else hot
    if hot.isEmpty():
        return left.join(right, on)
    cut = F.coalesce(F.col("_salts"), F.lit(1))
    every = F.explode(F.sequence(F.lit(0), cut - 1))

    def cells(rows: DataFrame, spread: Column, own: str, other: str) -> DataFrame:
        marked = rows.join(F.broadcast(hot), on, "left").withColumn(own, F.pmod(F.xxhash64(spread), cut).cast("int"))
        return marked.withColumn(other, every).drop("_salts")

    both = cells(left, spread_left, "_row", "_column").join(cells(right, spread_right, "_column", "_row"), [*on, "_row", "_column"])
    return both.drop("_row", "_column")


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """Rows numbered from 1 in the total order of ``order``, without a window over all of them in one task.

    The rows are sorted by range, each knows its place in its partition, and the partitions' sizes (one row each) are
    added up.
    """
    placed = materialize(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    placed = placed.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_p", "_i", "_m", "_before")
