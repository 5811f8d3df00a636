"""Matching the numbered texts of two editions by wording, and what follows from it."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.functions.text import number_key, shingles, words
from chronotext.operators.snapshots import ordinals, similar_texts
from chronotext.session import materialize

THRESHOLD = 0.5
# Words that turn a rule's meaning, and cross-references, which every renumbering changes.
FLIP_WORDS = "not no cannot can't can may must only never always instead unless except before after each any all".split()
XREF = r"(?i)\b(?:rules?|step)\s+\d+(?:\.\w+)*\.?|^\d+\.\s"


def normalised(text: Column) -> Column:
    """The text with cross-references blanked."""
    return F.regexp_replace(text, XREF, "rule #")


def flip_score(a: Column, b: Column) -> Column:
    """How many words that turn a meaning, or numbers, stand in one text only. Null if a text is null."""
    x, y = F.array_distinct(words(normalised(a))), F.array_distinct(words(normalised(b)))
    changed = F.concat(F.array_except(x, y), F.array_except(y, x))
    flips = F.array(*[F.lit(w) for w in FLIP_WORDS])
    return F.size(F.filter(changed, lambda w: F.array_contains(flips, w) | w.rlike("^[0-9]+$")))


def change_status(old_text: Column, old_number: Column, new_text: Column, new_number: Column) -> Column:
    """removed, added, changed, renumbered or unchanged; texts that differ in cross-references alone are not changed."""
    return (
        F.when(new_text.isNull(), "removed").when(old_text.isNull(), "added")
        .when(normalised(old_text) != normalised(new_text), "changed")
        .when(old_number != new_number, "renumbered").otherwise("unchanged")
    )


@F.pandas_udf(T.StringType())
def word_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Words of two texts as one line, [-removed-] and {+added+}. Null if either is null."""

    def diff(x: str | None, y: str | None) -> str | None:
        if x is None or y is None:
            return None
        parts = []
        old, new = x.split(), y.split()
        for kind, i, j, m, n in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
            if kind == "equal":
                parts.append(" ".join(old[i:j]))
            if kind in ("delete", "replace"):
                parts.append(f"[-{' '.join(old[i:j])}-]")
            if kind in ("insert", "replace"):
                parts.append(f"{{+{' '.join(new[m:n])}+}}")
        return " ".join(parts)

    return pd.Series([diff(x, y) for x, y in zip(a, b)])


def _paired_copies(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``hash``, ``old_number``, ``new_number``: one-to-one pairs of equal texts, at the same number first, then in the order of their numbers."""
    key = [*by, "hash"]
    sides = rows.groupBy(*key, "number").agg(F.max("old").alias("in_old"), F.max(~F.col("old")).alias("in_new"))
    sides = materialize(sides)
    same = sides.where("in_old AND in_new").select(*key, F.col("number").alias("old_number"), F.col("number").alias("new_number"))
    single = sides.where("NOT (in_old AND in_new)").select(*key, "number", F.col("in_old").alias("old"))
    placed = ordinals(single, [*key, "old"])
    both = placed.groupBy(*key, "k").agg(F.max(F.when(F.col("old"), F.col("number"))).alias("old_number"), F.max(F.when(~F.col("old"), F.col("number"))).alias("new_number"))
    return same.unionByName(both.where("old_number IS NOT NULL AND new_number IS NOT NULL").drop("k"))


def align(old: DataFrame, new: DataFrame, by: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """``by``, ``old_number``, ``old_text``, ``new_number``, ``new_text``, ``similarity``: every old text with its match, and new ones that nothing matched.

    ``old`` and ``new`` have ``by``, number and text. Equal texts pair one to one. Each other old text takes the most similar
    new one if they share at least ``threshold`` of their three-word sequences (so two may take the same), ties going to the
    first in number order; else it has none and similarity 0. Rows with a null in ``by``, number or text are left out and repeated rows count
    once. Rows are matched by numbers and hashes of texts (16 bytes); sequences are made of each text once, and the texts themselves join
    at the end. No version is gathered in one task; texts meet only through their rarer shared sequences.
    """
    by = list(by)
    known = " AND ".join(f"{c} IS NOT NULL" for c in (*by, "number", "text"))
    hashed = lambda rows, side: rows.select(*by, "number", "text").where(known).withColumn("hash", F.unhex(F.md5("text"))).withColumn("old", F.lit(side))
    full = materialize(hashed(old, True).unionByName(hashed(new, False)))
    rows = materialize(full.select(*by, "number", "hash", "old").distinct())
    exact = materialize(_paired_copies(rows, by))
    left = rows.where("old").select(*by, "number", "hash").join(exact.select(*by, F.col("old_number").alias("number"), "hash"), [*by, "number", "hash"], "left_anti")
    left = materialize(left)
    # Only editions in which something is left need their sequences.
    asked = left.select(*by, "hash").withColumn("old", F.lit(True)).unionByName(rows.where("NOT old").select(*by, "hash", "old").join(left.select(*by).distinct(), by, "left_semi")).distinct()
    # Through a generator, so that the words are made once and not for each sequence.
    texts = full.select("hash", "text").join(asked.select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.any_value("text").alias("text")).select("hash", F.explode(F.array(words(F.col("text")))).alias("w"))
    made = materialize(asked.join(texts.select("hash", shingles(F.col("w")).alias("grams")), "hash"))
    edges = similar_texts(made, by, threshold)
    first = rows.where("NOT old").groupBy(*by, F.col("hash").alias("new_hash")).agg(F.min(F.struct(number_key(F.col("number")).alias("key"), "number")).alias("at"))
    nearest = F.min(F.struct((-F.col("sim")).alias("less"), F.col("at.key").alias("key"), F.col("at.number").alias("new_number"), "new_hash"))
    best = edges.join(first, [*by, "new_hash"]).groupBy(*by, F.col("old_hash").alias("hash")).agg(nearest.alias("m"))
    similar = left.join(best, [*by, "hash"], "left").select(
        *by, F.col("number").alias("old_number"), F.col("hash").alias("old_hash"), "m.new_number", "m.new_hash", F.coalesce(-F.col("m.less"), F.lit(0.0)).alias("similarity")
    )
    equal = exact.select(*by, "old_number", F.col("hash").alias("old_hash"), "new_number", F.col("hash").alias("new_hash"), F.lit(1.0).alias("similarity"))
    matched = materialize(equal.unionByName(similar))
    used = matched.where("new_number IS NOT NULL").select(*by, F.col("new_number").alias("number"), F.col("new_hash").alias("hash")).distinct()
    added = rows.where("NOT old").select(*by, "number", "hash").join(used, [*by, "number", "hash"], "left_anti")
    nothing, no_hash = F.lit(None).cast("string"), F.lit(None).cast("binary")
    added = added.select(*by, nothing.alias("old_number"), no_hash.alias("old_hash"), F.col("number").alias("new_number"), F.col("hash").alias("new_hash"), F.lit(0.0).alias("similarity"))
    everything = matched.unionByName(added)
    # The texts, once for each place and hash.
    said = lambda side, name: full.where(F.col("old") if side else ~F.col("old")).groupBy(*by, F.col("number").alias(f"{name}_number"), F.col("hash").alias(f"{name}_hash")).agg(F.any_value("text").alias(f"{name}_text"))
    told = everything.join(said(True, "old"), [*by, "old_number", "old_hash"], "left").join(said(False, "new"), [*by, "new_number", "new_hash"], "left")
    return told.select(*by, "old_number", "old_text", "new_number", "new_text", "similarity")


def top_changes(changes: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The ``n`` changed rules of each ``by`` whose wording most likely turns the meaning: most ``flips`` first, then the least similar, then by number; with their ``rank``."""
    order = Window.partitionBy(*by).orderBy(F.desc("flips"), "similarity", number_key(F.col("old_number")), "old_number")
    return changes.where("status = 'changed'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def what_changed(matches: DataFrame, by: Sequence[str]) -> DataFrame:
    """``matches`` with ``status`` and ``flips``."""
    status = change_status(F.col("old_text"), F.col("old_number"), F.col("new_text"), F.col("new_number"))
    return matches.withColumn("status", status).withColumn("flips", F.when(F.col("status") == "changed", flip_score(F.col("old_text"), F.col("new_text"))))


def counterparts(changes: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, ``number`` (of the newer edition), ``old_number``, ``same_text`` of every matched pair."""
    pairs = changes.where("old_text IS NOT NULL AND new_text IS NOT NULL")
    return pairs.select(*by, F.col("new_number").alias("number"), "old_number", (normalised(F.col("old_text")) == normalised(F.col("new_text"))).alias("same_text"))


def impact(references: DataFrame, changes: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Each exploded reference (``by``, ``number``, ``key``) with the ``status`` of its rule, "missing" if there is none."""
    status = changes.where("old_number IS NOT NULL").groupBy(*by, F.col("old_number").alias("number")).agg(F.min("status").alias("status"))
    return references.join(status, [*by, "number"], "left").select(*by, key, "number", F.coalesce("status", F.lit("missing")).alias("status"))


def rule_history(changes: DataFrame, by: str, edition: str) -> DataFrame:
    """``by``, ``number``, ``status`` of each rule of the latest edition: new (nothing in the edition before matches), stable or changed.

    ``changes`` matches the latest edition with each older one (``edition``, comparable); ``previous`` of them is the newest older one.
    """
    rows = changes.where("new_number IS NOT NULL")
    newest = changes.groupBy(by).agg(F.max(edition).alias("_newest"))
    same = normalised(F.col("old_text")) == normalised(F.col("new_text"))
    judged = rows.join(newest, by).groupBy(by, F.col("new_number").alias("number")).agg(
        F.max(F.when((F.col(edition) == F.col("_newest")) & F.col("old_number").isNotNull(), 1).otherwise(0)).alias("known"),
        F.min(F.when(F.col("old_number").isNotNull(), same.cast("int"))).alias("same"),
    )
    status = F.when(F.col("known") == 0, "new").when(F.col("same") == 1, "stable").otherwise("changed")
    return judged.select(by, "number", status.alias("status"))
