"""Dated questions whose rule changed its meaning: what a search without dates answers, kept as evidence that can be graded again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.operators.evaluate import first_rank

NO_REFS = "array<string>"


def candidate_faults(candidates: DataFrame, key: str) -> DataFrame:
    """``key``, ``both``: questions with references that are called current and stale at once, which no verdict may rest on."""
    both = F.array_sort(F.array_intersect("current_refs", "stale_refs"))
    return candidates.select(key, both.alias("both")).where("size(both) > 0").distinct()


def label_faults(labels: DataFrame, key: str, expect: str, known: DataFrame, ref: str) -> DataFrame:
    """``key``, ``fault``, ``missing``: questions that expect nothing, or references that no passage carries. A null array expects nothing."""
    none = labels.where(F.coalesce(F.size(expect), F.lit(0)) < 1).select(key, F.lit("no expected sources").alias("fault"), F.array().cast(NO_REFS).alias("missing"))
    each = labels.select(key, F.explode(expect).alias("_ref")).where("_ref IS NOT NULL").distinct()
    unknown = each.join(known.select(F.col(ref).alias("_ref")).distinct(), "_ref", "left_anti")
    missing = unknown.groupBy(key).agg(F.array_sort(F.collect_set("_ref")).alias("missing"))
    return none.distinct().unionByName(missing.select(key, F.lit("refs not in the corpus").alias("fault"), "missing"))


def verdict(top_refs: Column, current: Column, stale: Column) -> Column:
    """captured (the first result says something outdated), not captured, or inconclusive (neither, or no result)."""
    some = lambda refs: F.coalesce(F.arrays_overlap(top_refs, refs), F.lit(False))
    return F.when(some(stale), "captured").when(some(current), "not captured").otherwise("inconclusive")


def fixtures(candidates: DataFrame, ranked: DataFrame, key: str) -> DataFrame:
    """``candidates`` with ``verdict``, ``first_current_rank``, ``first_stale_rank`` and ``results``: all about a search but the texts.

    ``candidates`` has ``key``, current_refs and stale_refs (null: none), ``ranked`` ``key``, rank, refs (qualified), source_ref, in_effect, content_hash and
    distance. ``results`` is an array in rank order; a question without results has null.
    """
    one = F.struct("rank", "source_ref", "refs", "in_effect", "distance", "content_hash")
    labels = candidates.select(key, *[F.coalesce(c, F.array().cast(NO_REFS)).alias(f"_{c}") for c in ("current_refs", "stale_refs")])
    carries = lambda refs: F.arrays_overlap("refs", refs)
    found = ranked.join(labels, key).groupBy(key).agg(
        F.array_sort(F.collect_list(one)).alias("results"), first_rank(F.col("rank"), carries("_current_refs")).alias("first_current_rank"),
        first_rank(F.col("rank"), carries("_stale_refs")).alias("first_stale_rank"),
    )
    kept = candidates.join(found, key, "left")
    said = verdict(F.get("results", F.lit(0))["refs"], F.col("current_refs"), F.col("stale_refs"))
    return kept.withColumn("verdict", said)


def regraded(stored: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``key``, ``recorded``, ``now``, ``changed``: stored fixtures read again under corrected labels, without another search."""
    new = labels.select(key, F.col("current_refs").alias("_current"), F.col("stale_refs").alias("_stale"), F.lit(True).alias("_known"))
    now = F.when(F.col("_known"), verdict(F.get("results", F.lit(0))["refs"], F.col("_current"), F.col("_stale"))).otherwise("no candidate")
    rows = stored.join(new, key, "left").select(key, F.col("verdict").alias("recorded"), now.alias("now"))
    return rows.withColumn("changed", F.col("recorded") != F.col("now"))


def audit(candidates: DataFrame, counterparts: DataFrame, key: str) -> DataFrame:
    """``key``, ``ref``, ``old_ref``, ``label``: every older counterpart of the rules that a candidate calls current: stale, current or NEITHER.

    ``counterparts`` has ``ref`` and ``old_ref``, both with their versions.
    """
    named = candidates.select(key, "current_refs", "stale_refs", F.explode("current_refs").alias("ref")).distinct()
    has = lambda refs: F.coalesce(F.array_contains(refs, F.col("old_ref")), F.lit(False))
    label = F.when(has("stale_refs"), "stale").when(has("current_refs"), "current").otherwise("NEITHER")
    return named.join(counterparts.select("ref", "old_ref").distinct(), "ref").select(key, "ref", "old_ref", label.alias("label")).distinct()


def shown(stored: DataFrame, passages: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The results of stored fixtures (``columns`` and one row each) with the texts that still have their hash; ``text`` is null where the corpus changed."""
    rows = stored.select(*columns, F.explode("results").alias("r")).select(*columns, "r.*")
    texts = passages.groupBy("source_ref", "content_hash").agg(F.min("text").alias("text"))
    return rows.join(texts, ["source_ref", "content_hash"], "left")
