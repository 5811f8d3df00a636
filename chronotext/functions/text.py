"""Words, shingles and canonical forms as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space and as a quote when two texts are compared.
BLANKS = r"[\s\u0085\p{Z}]+"
CURLY = "‘’‚‛“”„‟"
#: Texts that ``canonical`` leaves as they are: plain words of ASCII with single blanks between them.
CLEAN = r"\A(?:[!-~]++ )*+[!-~]++\z"
STRAIGHT = "''''\"\"\"\""


def collapse(text: Column) -> Column:
    """White space of every kind as single blanks, none at the ends. Null stays null."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def canonical(text: Column) -> Column:
    """``collapse`` with straight quotes: equal for texts that differ only in layout or in the kind of quotes."""
    return F.when(text.rlike(CLEAN), text).otherwise(collapse(F.translate(text, CURLY, STRAIGHT)))


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and apostrophes, lower-cased; a curly apostrophe is an apostrophe. Null gives null."""
    return F.regexp_extract_all(F.lower(F.translate(text, "‘’", "''")), F.lit("[a-z0-9']+"), F.lit(0))


def shingles(tokens: Column, n: int = 3) -> Column:
    """Distinct hashed n-word sequences; a text of 1 to n-1 words gives one sequence of them all, one of none gives none.

    ``tokens`` must be a column that was computed before, else it is computed once for each position.
    """
    size = F.size(tokens)
    parts = F.arrays_zip(*[F.slice(tokens, i + 1, F.greatest(size - (n - 1), F.lit(0))).alias(f"w{i}") for i in range(n)])
    long = F.array_distinct(F.transform(parts, lambda x: F.xxhash64(*[x[f"w{i}"] for i in range(n)])))
    short = F.when(size > 0, F.array(F.xxhash64(F.array_join(tokens, " ")))).otherwise(F.array().cast("array<bigint>"))
    return F.when(size >= n, long).otherwise(short)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two arrays of distinct members; two empty ones have 1."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def reference(text: Column) -> Column:
    """A qualified reference without letter case, surrounding blanks and trailing dots."""
    return F.lower(F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}.]+$", ""))


def unversioned(ref: Column) -> Column:
    """``core@1.3:419.4`` as ``core:419.4``."""
    return F.regexp_replace(ref, "@[^:]*:", ":")


def number_key(number: Column) -> Column:
    """A string that sorts as the rule number does: 2 before 10, letters in alphabetical order."""
    return F.array_join(F.transform(F.split(number, r"\."), lambda x: F.when(x.rlike("^[0-9]+$"), F.lpad(x, 10, "0")).otherwise(x)), ".")
