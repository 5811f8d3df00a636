"""Grading ranked lists: first ranks, recall, stale copies, paired runs, misses and latencies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.operators.stats import mcnemar_p, wilson
from chronotext.session import materialize

KS = (1, 3, 5, 10, 20)
CUTOFF = 5
RULE_ONLY = ("general-rules", "mechanics")


def first_rank(rank: Column, condition: Column) -> Column:
    """Aggregate: the lowest rank of the rows for which ``condition`` holds, null if none."""
    return F.min(F.when(condition, rank))


def qualified(document: Column, numbers: Column) -> Column:
    """``numbers`` of a document's version (``core@1.4``) as references (``core@1.4:419.4``); null for a null document or array."""
    return F.transform(numbers, lambda n: F.concat(document, F.lit(":"), n))


def expectations(asked: DataFrame, held: DataFrame) -> DataFrame:
    """``q``, ``expect``, ``differing``, ``copies``: references that answer a question, and those of the same rules in editions not in force.

    ``asked`` has ``q`` and ``rule`` (one row each), ``held`` a row for each rule that a passage carries: ``rule``, ``ref`` (with its version),
    ``text_hash`` and ``in_effect``. ``expect`` are the references in effect, ``copies`` the others, ``differing`` those of the copies whose text none
    of the expected ones has. A question without any has empty arrays. An array is as long as a rule has editions.
    """
    rules = asked.select("q", "rule").where("q IS NOT NULL").distinct()
    met = rules.join(held.select("rule", "ref", "text_hash", F.coalesce("in_effect", F.lit(False)).alias("in_effect")).distinct(), "rule", "left")
    now, then = F.col("in_effect"), ~F.col("in_effect")
    sets = met.groupBy("q").agg(
        F.collect_set(F.when(now, F.col("ref"))).alias("expect"), F.collect_set(F.when(now, F.col("text_hash"))).alias("texts"),
        F.collect_set(F.when(then, F.struct("ref", "text_hash"))).alias("old"),
    )
    named = lambda rows: F.array_distinct(F.transform(rows, lambda x: x["ref"]))
    differing = F.filter("old", lambda x: ~F.coalesce(F.array_contains("texts", x["text_hash"]), F.lit(False)))
    return sets.select("q", F.array_sort("expect").alias("expect"), F.array_sort(named(differing)).alias("differing"), F.array_sort(named(F.col("old"))).alias("copies"))


def grade(ranked: DataFrame, by: Sequence[str], wanted: Column, copy: Column, in_effect: Column, either: Column | None = None) -> DataFrame:
    """``by``, ``hit_rank`` (wanted and in effect), ``outdated_rank`` (a differing copy not in effect), ``blind_rank`` (wanted or any copy, whenever valid).

    ``either`` is wanted or any copy, where copies with the same text don't count as differing.
    """
    r = F.col("rank")
    return ranked.groupBy(*by).agg(
        first_rank(r, wanted & in_effect).alias("hit_rank"), first_rank(r, copy & ~in_effect).alias("outdated_rank"),
        first_rank(r, wanted | copy if either is None else either).alias("blind_rank"),
    )


def recall_at(graded: DataFrame, groups: Sequence[Sequence[str]], ks: Sequence[int] = KS) -> DataFrame:
    """``n``, ``hits_k``, ``recall_k`` of each grouping set. Rows that could not be graded must not be in ``graded``."""
    columns = list(dict.fromkeys(c for g in groups for c in g))
    hits = [F.count(F.when(F.col("hit_rank") <= k, 1)).alias(f"hits_{k}") for k in ks]
    sets = [[F.col(c) for c in g] for g in groups]
    rows = graded.groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("n"), *hits)
    return rows.select("*", *[(F.col(f"hits_{k}") / F.col("n")).alias(f"recall_{k}") for k in ks])


def stale_above(graded: DataFrame, by: Sequence[str], cutoff: int = CUTOFF) -> DataFrame:
    """``n``, ``stale``: how often an outdated copy stands within the cutoff and above the hit; with Wilson's interval."""
    stale = (F.col("outdated_rank") <= cutoff) & (F.col("hit_rank").isNull() | (F.col("outdated_rank") < F.col("hit_rank")))
    rows = graded.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(stale, 1)).alias("stale"))
    return rows.withColumn("interval", wilson(F.col("stale"), F.col("n")))


def paired(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Full outer match of two runs: ``key``, ``state`` (both, only_a, only_b), the ``columns`` of either."""
    left = a.select(key, *[F.col(c).alias(f"{c}_a") for c in columns], F.lit(True).alias("_a"))
    right = b.select(key, *[F.col(c).alias(f"{c}_b") for c in columns], F.lit(True).alias("_b"))
    state = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("both")
    return left.join(right, key, "full_outer").withColumn("state", state).drop("_a", "_b")


def compare(a: DataFrame, b: DataFrame, key: str, by: Sequence[str], k: int = CUTOFF) -> DataFrame:
    """``by``, ``n``, ``gained``, ``lost``, ``p``: questions that only run b, only run a hit within ``k``; exact McNemar.

    Runs on different questions are two experiments, not two configurations: a question that only one has raises an error.
    """
    hit = F.coalesce(F.col("hit_rank") <= k, F.lit(False))
    both = a.select(key, *by, hit.alias("hit_a")).join(b.select(key, hit.alias("hit_b")), key, "full_outer")
    one_sided = F.col("hit_a").isNull() | F.col("hit_b").isNull()
    refused = F.raise_error(F.concat(F.lit("runs differ in their questions; they cannot be paired: "), F.col(key).cast("string"))).cast("boolean")
    both = both.withColumn("hit_b", F.when(one_sided, refused).otherwise(F.col("hit_b")))
    return discordant(both, by, F.col("hit_a"), F.col("hit_b"))


def discordant(rows: DataFrame, by: Sequence[str], a: Column, b: Column) -> DataFrame:
    """``by``, ``n``, ``gained`` (only ``b``), ``lost`` (only ``a``), ``p`` of exact McNemar; both conditions known in every row."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(b & ~a, 1)).alias("gained"), F.count(F.when(a & ~b, 1)).alias("lost"))
    return counts.withColumn("p", mcnemar_p(F.col("gained"), F.col("lost")))


def run_entry(graded: DataFrame, paired_with: DataFrame | None, key: str, groups: Sequence[Sequence[str]]) -> DataFrame:
    """A run in one row a grouping set: ``recall_at`` of all depths, ``stale`` (an outdated copy above the hit) and, against another run, ``gained``, ``lost``, ``p``."""
    columns = list(dict.fromkeys(c for g in groups for c in g))
    within = F.coalesce(F.col("hit_rank") <= CUTOFF, F.lit(False))
    rows = graded.withColumn("_hit", within)
    if paired_with is not None:
        rows = rows.join(paired_with.select(key, within.alias("_other")), key, "left")
    stale = (F.col("outdated_rank") <= CUTOFF) & (F.col("hit_rank").isNull() | (F.col("outdated_rank") < F.col("hit_rank")))
    counts = [F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("hit_rank") <= k, 1)).alias(f"hits_{k}") for k in KS], F.count(F.when(stale, 1)).alias("stale")]
    if paired_with is not None:
        counts += [F.count(F.when(F.expr("_hit AND NOT _other"), 1)).alias("gained"), F.count(F.when(F.expr("_other AND NOT _hit"), 1)).alias("lost")]
    out = rows.groupingSets([[F.col(c) for c in g] for g in groups], *columns).agg(*counts)
    return out if paired_with is None else out.withColumn("p", mcnemar_p(F.col("gained"), F.col("lost")))


def accuracy_given_hit(answers: DataFrame, by: Sequence[str], hit_rank: Column, verdict: Column, k: int = CUTOFF) -> DataFrame:
    """``by``, ``hits``, ``right_given_hit``, ``n``, ``right``, ``not_answered``, ``unparsed`` and Wilson's intervals of the two rates. Rows without a verdict don't count."""
    rows = answers.where(verdict.isNotNull()).select(*by, F.coalesce(hit_rank <= k, F.lit(False)).alias("_hit"), verdict.alias("_said"))
    said = lambda what: F.col("_said") == what
    counts = rows.groupBy(*by).agg(
        F.count(F.when(F.col("_hit"), 1)).alias("hits"), F.count(F.when(F.col("_hit") & said("correct"), 1)).alias("right_given_hit"), F.count(F.lit(1)).alias("n"),
        F.count(F.when(said("correct"), 1)).alias("right"), F.count(F.when(said("not_answered"), 1)).alias("not_answered"), F.count(F.when(said("unparsed"), 1)).alias("unparsed"),
    )
    return counts.withColumn("given_hit", wilson(F.col("right_given_hit"), F.col("hits"))).withColumn("overall", wilson(F.col("right"), F.col("n")))


def judged_runs(base: DataFrame, other: DataFrame, questions: DataFrame, key: str, columns: Sequence[str] = ()) -> DataFrame:
    """``key``, ``columns`` of the questions, ``right_base``, ``right_other``: the questions of two judged runs that both have a verdict for.

    ``base`` and ``other`` have ``key`` and ``verdict``; "unparsed" is no verdict, and answers to questions that no longer exist don't count.
    """
    usable = lambda run, name: run.where("verdict IS NOT NULL AND verdict <> 'unparsed'").select(key, (F.col("verdict") == "correct").alias(name))
    return questions.select(key, *columns).join(usable(base, "right_base"), key).join(usable(other, "right_other"), key)


def miss_category(graded: Column, hit_rank: Column, category: Column, cutoff: int = CUTOFF) -> Column:
    """Why a question missed; null for a hit."""
    return (
        F.when(~F.coalesce(graded, F.lit(False)), "unclassified").when(hit_rank <= cutoff, F.lit(None)).when(hit_rank.isNotNull(), "below-cutoff")
        .when(category == "cards", "card-not-in-corpus").when(category.isin(*RULE_ONLY), "rule-only").otherwise("unclassified")
    )


def crosstab(rows: DataFrame, by: str, column: str, values: Sequence[str], total_row: bool = False) -> DataFrame:
    """Counts of ``values`` a ``by``, zeros included, and the ``total`` of all rows; ``total_row`` adds one for all of them, told by ``is_total``."""
    counts = [F.count(F.when(F.col(column) == v, 1)).alias(v) for v in values]
    if not total_row:
        return rows.groupBy(by).agg(*counts, F.count(F.lit(1)).alias("total"))
    return rows.groupingSets([[F.col(by)], []], by).agg(*counts, F.count(F.lit(1)).alias("total"), (F.grouping(by) == 1).alias("is_total"))


def _same(keys: Sequence[str]) -> Column:
    """Equality of ``keys`` with the columns of the same names and an underscore; nulls are equal."""
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in keys])


def latency_summary(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by``, ``n``, ``median`` (mean of the middle two), ``p90`` (the value at place floor(0.9 (n - 1)), from 0), ``max``.

    Null values don't count. Equal values are counted first, these counts are sorted by range, and only the ranges that hold one of
    the places asked for are looked into: no task sees more of a group than its range.
    """
    keys = [*by, "_one"]
    counted = rows.where(F.col(value).isNotNull()).withColumn("_one", F.lit(1)).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("c"))
    placed = materialize(counted.orderBy(*keys, "_v").withColumn("_range", F.spark_partition_id()))
    order = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row a group and range.
    ranges = placed.groupBy(*keys, "_range").agg(F.sum("c").alias("held")).withColumn("upto", F.sum("held").over(order))
    totals = placed.groupBy(*keys).agg(F.sum("c").alias("n"), F.max("_v").alias("max"))
    n = F.col("n")
    places = F.array_distinct(F.array(F.floor((n - 1) / 2), F.floor(n / 2), F.floor((n - 1) * F.lit(9) / 10)))
    wanted = totals.withColumn("place", F.explode(places))
    inside = ranges.join(wanted.withColumnsRenamed({c: f"{c}_" for c in keys}).select(*[f"{c}_" for c in keys], "place"), _same(keys))
    inside = inside.where("upto - held <= place AND place < upto").select(*[F.col(c).alias(f"{c}_") for c in keys], F.col("_range").alias("r_"), (F.col("upto") - F.col("held")).alias("before"), "place")
    found = placed.join(inside, _same(keys) & (F.col("_range") == F.col("r_")))
    reached = F.sum("c").over(Window.partitionBy(*keys, "place").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
    values = found.withColumn("reached", reached).where("reached > place").groupBy(*keys, "place").agg(F.min("_v").alias("at"))
    named = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("place", "at"))).alias("at"))
    both = totals.withColumnsRenamed({c: f"{c}_" for c in keys}).join(named, _same(keys))
    at = lambda place: F.element_at("at", place)
    return both.select(*by, "n", ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median"), at(F.floor((n - 1) * F.lit(9) / 10)).alias("p90"), "max")
