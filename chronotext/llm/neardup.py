"""Texts that are copies of one another but for small edits, insertions and moved sentences.

Every text becomes the set of its hashed three-word sequences. Equal sets form one class. Classes are filed under the
rarest of their sequences and under the band of their size; such a tile holds all classes that can reach the similarity
with each other through that sequence. Of what meets in a tile, places and sizes and then the bit counts of 512-bit signatures bound
the overlap from above; what passes is counted exactly on the sorted arrays. No pair of different texts above the threshold is lost.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.session import materialize
from chronotext.skew import fits, grid_join, hot_keys, salted_join

THRESHOLD = 0.5
MIN_WORDS = 12
#: Words of a sequence, and 64-bit words of a signature.
RUN, SIGNATURE = 3, 8
#: Up to so many row numbers are sent to every executor; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: A frequency counts up to this; it stands above the MARK bits of its sequence in one number.
MOST, MARK = (1 << 15) - 1, 48
#: Words of texts that are hashed at a time, and distinct words that a worker remembers.
SLICE, REMEMBERED = 500_000, 300_000
SEED = 20261128

_WORD = re.compile(r"[a-z0-9']+")
_hashes: dict[str, int] = {}


def without_number(text: Column, number: Column) -> Column:
    """The text without its own number at the head, bare, bracketed or dotted. Other leading numbers stay."""
    head = r"^[\s\p{Z}]*[\[({]?[\s\p{Z}]*(\p{Alnum}+(?:\.\p{Alnum}+)*)\.?[\s\p{Z}]*[\])}]?[.:]?(?=[\s\p{Z}]|$)"
    own = F.lower(F.regexp_extract(text, head, 1)) == F.lower(F.trim(number))
    return F.when(own, F.regexp_replace(text, head, "")).otherwise(text)


def _word_hash(word: str) -> int:
    if (h := _hashes.get(word)) is None:
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        if len(word) <= 40:
            if len(_hashes) >= REMEMBERED:
                _hashes.clear()
            _hashes[word] = h
    return h


def _mixed(x: np.ndarray, odd: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(odd | 1)
    return x ^ (x >> np.uint64(32))


def sequence_sets(words: list[list[str]]) -> dict[str, np.ndarray]:
    """Of texts of RUN words at least: ``grams`` (the sorted distinct hashed sequences, text after text), their number ``n``, two keys of the set and its signature."""
    sizes = np.array([len(w) for w in words])
    codes = np.fromiter((_word_hash(w) for text in words for w in text), np.uint64, sizes.sum())
    ends = np.cumsum(sizes)
    starts_one = np.ones(len(codes), bool)
    for back in range(1, RUN):
        starts_one[ends - back] = False
    at = np.flatnonzero(starts_one)
    odd = np.random.default_rng(SEED).integers(1, 2**63, RUN + 3, dtype=np.uint64) | np.uint64(1)
    grams = _mixed(sum(codes[at + i] * odd[i] for i in range(RUN)), int(odd[RUN])).view(np.int64)
    owner = np.repeat(np.arange(len(words)), sizes - RUN + 1)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])]
    grams, owner = grams[new], owner[new]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    bits = grams.view(np.uint64)
    place, bit = (bits >> np.uint64(6)) % np.uint64(SIGNATURE), np.uint64(1) << (bits & np.uint64(63))
    out = {"n": np.diff(np.r_[first, len(grams)]).astype(np.int32)}
    for i in (1, 2):
        out[f"k{i}"] = np.add.reduceat(_mixed(bits, int(odd[RUN + i])), first).view(np.int64)
    for i in range(SIGNATURE):
        out[f"s{i}"] = np.bitwise_or.reduceat(np.where(place == i, bit, np.uint64(0)), first).view(np.int64)
    return out | {"grams": grams}


_NUMBERS = ["n", "k1", "k2", *[f"s{i}" for i in range(SIGNATURE)]]


def text_sets(texts: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``id``, ``n``, ``k1``, ``k2``, the signature ``s0``, ... and ``grams`` of each row of ``texts`` (id, text) with enough words."""
    enough = max(min_words, RUN)

    def sliced(ids: list[int], texts: list[str]) -> Iterator[tuple[list[int], list[list[str]]]]:
        kept: list[int] = []
        words: list[list[str]] = []
        total = 0
        for key, text in zip(ids, texts):
            found = _WORD.findall(text.replace("‘", "'").replace("’", "'").lower())
            if len(found) >= enough:
                kept.append(key)
                words.append(found)
                total += len(found)
            if total > SLICE:
                yield kept, words
                kept, words, total = [], [], 0
        if kept:
            yield kept, words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words in sliced(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                made = sequence_sets(words)
                offsets = pa.array(np.r_[0, np.cumsum(made["n"])].astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(made["grams"]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(made[c]) for c in _NUMBERS], lists], ["id", *_NUMBERS, "grams"])

    numbers = ", ".join(f"{c} {'int' if c == 'n' else 'bigint'}" for c in _NUMBERS)
    return texts.where("id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, f"id bigint, {numbers}, grams array<bigint>")


def text_classes(texts: DataFrame, *, row_id: Column, text: Column, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """Membership (``id``, ``cid``, ``class_id``, ``lone``) and classes (``cid``, ``class_id``, ``lone``, ``n``, signature, ``grams`` sorted) of the texts with enough words.

    A class is a set of sequences, told by two 64-bit sums over them; its ``class_id`` is the lowest ``row_id`` in it, ``lone`` says that it
    has one row. Null ids and null texts are left out, repeated rows count once; of an id with several texts each text counts (``cid``, the
    number of a row, tells its classes apart). Texts need RUN words at least, whatever ``min_words``.
    """
    sets = materialize(text_sets(texts.select(row_id.cast("bigint").alias("id"), text.alias("text")), min_words).withColumn("cid", F.monotonically_increasing_id()))
    # Only classes of several rows are put together, so that the sets of the others needn't move.
    several = sets.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows"), F.min("cid").alias("first"), F.min("id").alias("class_id"))
    several = materialize(several.where("rows > 1").drop("rows"))
    keys = sets.select("k1", "k2", "id", "cid")
    few = fits(several, BROADCAST_ROWS)
    together = keys.join(F.broadcast(several), ["k1", "k2"]) if few else salted_join(keys, several, ["k1", "k2"], F.col("cid"))
    together = materialize(together.select("id", "cid", "first", "class_id"))
    marks = together.select("cid", (F.col("cid") == F.col("first")).alias("stands"), F.col("class_id").alias("of"))
    classes = sets.join(F.broadcast(marks) if few and fits(marks, BROADCAST_ROWS) else marks, "cid", "left").where("stands IS NULL OR stands")
    classes = classes.select("cid", F.coalesce("of", "id").alias("class_id"), F.col("of").isNull().alias("lone"), "n", *_NUMBERS[3:], "grams")
    alone = classes.where("lone").select(F.col("class_id").alias("id"), "cid", "class_id", "lone")
    mates = together.select("id", F.col("first").alias("cid"), "class_id", F.lit(False).alias("lone")).distinct()
    return alone.unionByName(mates), classes


def _heads(classes: DataFrame, threshold: float) -> DataFrame:
    """``cid``, ``n``, ``common``, ``prefix``: the rarest sequences of each class that another class has too, rarest first, as frequency and sequence in one number.

    Of two sets with similarity t the larger shares one of its first n - ceil(t n) + 1 sequences with the first n - ceil(2 t / (1 + t) n) + 1 of
    the smaller, in any order common to all; rarest first keeps tiles small. Sequences of one class alone take up their place but need
    no posting: ``common`` says how many are not of that kind.
    """
    grams = classes.select("cid", F.explode("grams").alias("g"))
    common = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mark = F.shiftleft(F.least("df", F.lit(MOST)), MARK).bitwiseOR(F.col("g").bitwiseAND((1 << MARK) - 1))
    # Each sequence stands in ``common`` once: no more of it in a task than its share, so no side need be sorted.
    ranked = grams.join(common.hint("shuffle_hash"), "g").groupBy("cid").agg(F.sort_array(F.collect_list(mark)).alias("t"))
    ranked = ranked.join(classes.select("cid", "n"), "cid")
    prefix = F.slice("t", 1, F.greatest(F.lit(0), _first(threshold) - F.col("n") + F.size("t")))
    return ranked.select("cid", "n", F.size("t").alias("common"), prefix.alias("prefix")).where("size(prefix) > 0")


def _first(share: float) -> Column:
    """How many sequences of a class must be looked at, so that one is met that a set sharing ``share`` of them has too."""
    return (F.col("n") - F.ceil(F.col("n") * F.lit(share) - 1e-9) + 1).cast("int")


def _bits_only_in(one: str, other: str) -> Column:
    return reduce(Column.__add__, [F.bit_count(F.expr(f"{one}{i} & ~{other}{i}")) for i in range(SIGNATURE)])


def class_pairs(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``a`` < ``b`` (class numbers), ``sim`` of every two classes with similarity >= threshold, with ``class_id`` and ``lone`` of both.

    A tile that is hot on both sides is cut into a grid (``grid_join``).
    """
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9).cast("int")
    heads = materialize(_heads(classes, threshold)).select("cid", "n", "common", band.alias("band"), F.posexplode("prefix").alias("i", "t"))
    indexed = F.col("n") - F.col("common") + F.col("i") < _first(2 * threshold / (1 + threshold))
    # ``left``: how many of the class's sequences stand from there on.
    postings = heads.select("cid", "n", "band", "t", (F.col("common") - F.col("i")).alias("left"), indexed.alias("indexed"))
    # The larger class of a pair is at home in the tile of its band; the smaller stands there too or visits from the band below:
    # sizes that can be similar differ by one band at most.
    home = postings.select("t", F.col("band").alias("tile"), F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("left").alias("lx"))
    roles = postings.where("indexed").withColumn("up", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "t", (F.col("band") + F.col("up")).alias("tile"), F.col("cid").alias("y"), F.col("n").alias("ny"), F.col("left").alias("ly")
    )
    # A tile has no more rows of a side than its sequence has classes.
    busy = home.select("t", "tile").unionByName(roles.select("t", "tile")).where(F.shiftright("t", MARK) >= 10_000)
    met = grid_join(home, roles.hint("shuffle_hash"), ["t", "tile"], F.col("x"), F.col("y"), sizes_of=busy)
    wanted = (F.col("nx") + F.col("ny")) * F.lit(threshold) - 1e-6
    # A pair meets first where nothing before is shared: there the rest of either bounds the overlap.
    enough = F.least("lx", "ly") * (1 + threshold) >= wanted
    smaller = (F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x")))
    candidates = met.where(enough & smaller).select("x", "y").distinct()
    marks = lambda name: classes.select(F.col("cid").alias(name), F.col("n").alias(f"n{name}"), *[F.col(f"s{i}").alias(f"{name}{i}") for i in range(SIGNATURE)])
    sieved = candidates.join(marks("x"), "x").join(marks("y"), "y")
    bound = F.least(F.col("nx") - _bits_only_in("x", "y"), F.col("ny") - _bits_only_in("y", "x"))
    sieved = materialize(sieved.where(bound * (1 + threshold) >= wanted).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    # The arrays of those that are left.
    ends = sieved.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    ends = F.broadcast(ends) if fits(ends, BROADCAST_ROWS) else ends
    held = classes.select("cid", "class_id", "lone", "grams").join(ends, "cid", "left_semi")
    of = lambda name: held.select(*[F.col(c).alias(v) for c, v in (("cid", name), ("class_id", f"{name}_id"), ("lone", f"{name}_lone"), ("grams", f"{name}_grams"))])
    both = sieved.join(of("a"), "a").join(of("b"), "b").withColumn("both", F.size(F.array_intersect("a_grams", "b_grams")))
    sim = F.col("both") / (F.size("a_grams") + F.size("b_grams") - F.col("both"))
    return materialize(both.withColumn("sim", sim).where(F.col("sim") >= threshold).select("a", "b", "sim", "a_id", "a_lone", "b_id", "b_lone"))


def near_copies(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a`` < ``b``: every two ids whose texts are similar, class mates included. The result is as large as the pairs that exist."""
    mates = materialize(members.where("NOT lone"))
    hot = materialize(hot_keys(mates, ["cid"]))
    of = lambda name: hot.withColumnRenamed("cid", name)
    x, y = mates.select(F.col("cid").alias("a"), F.col("id").alias("x")), mates.select(F.col("cid").alias("b"), F.col("id").alias("y"))
    # Only a class may have many members; they are the side that is spread.
    links = pairs.select("a", "a_id", "a_lone", "b", "b_id", "b_lone")
    half = links.where("a_lone").select(F.col("a_id").alias("x"), "b", "b_id", "b_lone").unionByName(
        salted_join(x, links.where("NOT a_lone"), ["a"], F.col("x"), hot=of("a")).select("x", "b", "b_id", "b_lone")
    )
    across = half.where("b_lone").select("x", F.col("b_id").alias("y")).unionByName(salted_join(y, half.where("NOT b_lone"), ["b"], F.col("y"), hot=of("b")).select("x", "y"))
    inside = grid_join(x, y.withColumnRenamed("b", "a"), ["a"], F.col("x"), F.col("y"), hot=of("a")).where("x < y").select("x", "y")
    found = across.unionByName(inside).where("x <> y")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def copy_report(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id``, ``class_id``, ``links``: one row an id and text, with the number of other classes that its class is similar to."""
    links = pairs.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("links"))
    counted = salted_join(members, links, ["cid"], F.col("id"), "left")
    return counted.select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
