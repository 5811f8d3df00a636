"""What changed between consecutive full snapshots of versioned, numbered texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.functions.text import canonical, jaccard, number_key, shingles, words
from chronotext.session import materialize
from chronotext.skew import fits

THRESHOLD = 0.5
TOLERANCE = 0.001
#: Up to so many keys of unpaired texts (some 60 bytes each) are sent to every executor; beyond it their texts are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Edges of a comparison (some 100 bytes each) that one task may settle.
GROUP_EDGES = 500_000


def row_hash(text: Column) -> Column:
    """16 bytes, equal for texts that differ only in white space or in the kind of quotes."""
    return F.unhex(F.md5(canonical(text)))


def _current(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the latest delivery of each snapshot (without copies), and the snapshots with their successors."""
    snaps = rows.groupBy("doc", "snap").agg(F.max("delivered").alias("latest"))
    snaps = materialize(snaps.withColumn("next", F.lead("snap").over(Window.partitionBy("doc").orderBy("snap"))))
    # As many rows as there are snapshots: broadcast if they are few, else a shuffle join that AQE may split.
    side = F.broadcast(snaps) if fits(snaps, 200_000) else snaps
    kept = (
        rows.join(side, ["doc", "snap"])
        .where("delivered <=> latest AND number IS NOT NULL AND hash IS NOT NULL")
        .groupBy("doc", "snap", "next", "number", "hash")
        .agg(F.max("score").alias("score"))
    )
    return kept, side


def ordinals(rows: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` (``group``, number, ...) with ``k``: the place of a row among those of its ``group``, by number.

    The rank is taken in two steps, inside the first component of the number and then over the components' counts, so
    that no task sorts all copies of one text.
    """
    rows = rows.withColumn("sort", number_key(F.col("number"))).withColumn("part", F.substring_index("sort", ".", 1))
    inside = rows.withColumn("k", F.row_number().over(Window.partitionBy(*group, "part").orderBy("sort", "number")))
    counts = rows.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    return inside.join(offsets, [*group, "part"]).withColumn("k", F.col("k") + F.col("before")).drop("sort", "part", "before")


def similar_texts(texts: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """``by``, ``old_hash``, ``new_hash``, ``sim`` of every old and new text of a comparison with ``sim`` >= threshold.

    ``texts`` has ``by``, old (boolean), hash and ``grams`` (distinct hashed word sequences), a text once. Only texts that share
    one of their rarest sequences are compared (the prefix filter: of n sequences, n - ceil(t n) + 1 suffice), and the
    candidates are then counted exactly. Hashes and sequences move; texts don't.
    """
    key = [*by, "old", "hash"]
    grams = texts.select(*key, F.size("grams").alias("n"), F.explode("grams").alias("g"))
    # What stands on one side only leads nowhere; it comes first in the order, where it merely takes up its place.
    common = grams.groupBy(*by, "g").agg(F.count(F.lit(1)).alias("df"), F.max("old").alias("in_old"), F.max(~F.col("old")).alias("in_new"))
    common = common.where("in_old AND in_new").select(*by, "g", "df")
    # Frequency and sequence in one number.
    mark = F.shiftleft(F.least("df", F.lit((1 << 15) - 1)), 48).bitwiseOR(F.col("g").bitwiseAND((1 << 48) - 1))
    ranked = grams.join(common, [*by, "g"]).groupBy(*key, "n").agg(F.sort_array(F.collect_list(mark)).alias("marks"))
    keep = F.size("marks") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1
    heads = ranked.select(*key, F.explode(F.slice("marks", 1, F.greatest(F.lit(0), keep.cast("int")))).alias("g"))
    old = heads.where("old").select(*by, "g", F.col("hash").alias("old_hash"))
    new = heads.where("NOT old").select(*by, "g", F.col("hash").alias("new_hash"))
    candidates = old.join(new, [*by, "g"]).select(*by, "old_hash", "new_hash").distinct()
    a = texts.where("old").select(*by, F.col("hash").alias("old_hash"), F.col("grams").alias("ga"))
    b = texts.where("NOT old").select(*by, F.col("hash").alias("new_hash"), F.col("grams").alias("gb"))
    both = candidates.join(a, [*by, "old_hash"]).join(b, [*by, "new_hash"])
    return both.select(*by, "old_hash", "new_hash", jaccard(F.col("ga"), F.col("gb")).alias("sim")).where(F.col("sim") >= threshold)


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of whole comparisons whose edges come one comparison after the other, each from the most similar edge down."""
    comparison, used_old, used_new = None, {}, {}
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("doc", "snap", "old_hash", "new_hash", "n_old", "n_new", "at_old", "at_new")]
        taken: list[int] = []
        places: list[tuple[int, int, int]] = []
        for row, (doc, snap, old, new, n_old, n_new, at_old, at_new) in enumerate(zip(*columns)):
            if comparison != (doc, snap):
                comparison, used_old, used_new = (doc, snap), {}, {}
            i, j = used_old.get(old, at_old), used_new.get(new, at_new)
            if (n := min(n_old - i, n_new - j)) > 0:
                used_old[old], used_new[new] = i + n, j + n
                taken.append(row)
                places.append((i, j, n))
        kept = batch.take(pa.array(taken, pa.int64()))
        counts = [pa.array([p[k] for p in places], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("doc", "snap", "old_hash", "new_hash", "sim")), *counts], ["doc", "snap", "old_hash", "new_hash", "sim", "at_old", "at_new", "n"])


def _mutual_bests(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs that are the best of both their sides, which is what taking the pairs one by one would settle; and the edges that remain."""
    old, new = ["doc", "snap", "old_hash"], ["doc", "snap", "new_hash"]
    order = F.struct(-F.col("sim"), "old_hash", "new_hash")
    best_old = left.groupBy(*old).agg(F.min(order).alias("o")).select(*old, "o.new_hash")
    best_new = left.groupBy(*new).agg(F.min(order).alias("o")).select(*new, "o.old_hash")
    mutual = best_old.join(best_new, ["doc", "snap", "old_hash", "new_hash"])
    n = F.least(F.col("n_old") - F.col("at_old"), F.col("n_new") - F.col("at_new"))
    now = materialize(left.join(mutual, ["doc", "snap", "old_hash", "new_hash"]).withColumn("n", n))
    used_old, used_new = now.select(*old, F.col("n").alias("u_old")), now.select(*new, F.col("n").alias("u_new"))
    rest = (
        left.join(mutual, ["doc", "snap", "old_hash", "new_hash"], "left_anti")
        .join(used_old, old, "left").join(used_new, new, "left")
        .withColumn("at_old", F.col("at_old") + F.coalesce("u_old", F.lit(0)))
        .withColumn("at_new", F.col("at_new") + F.coalesce("u_new", F.lit(0)))
        .where("at_old < n_old AND at_new < n_new").drop("u_old", "u_new")
    )
    return now, materialize(rest)


def greedy_pairs(edges: DataFrame, group_edges: int = GROUP_EDGES) -> DataFrame:
    """One-to-one pairs of text classes, the most similar first; ``at_old``/``at_new``: how many copies were paired before, ``n``: how many now.

    ``edges`` has doc, snap, old_hash, new_hash, sim, n_old, n_new (copies of each class). Ties go to the smaller hashes. A comparison of
    up to ``group_edges`` edges is settled in one task; a larger one first in rounds, each of which settles all pairs that are the best
    of both their sides, until what is left of it is small enough. Every round settles a pair at least, so they come to an end.
    """
    columns = ["doc", "snap", "old_hash", "new_hash", "sim", "at_old", "at_new", "n"]
    left = materialize(edges.withColumns({"at_old": F.lit(0).cast("bigint"), "at_new": F.lit(0).cast("bigint")}))
    empty = left.withColumn("n", F.lit(0).cast("bigint")).select(*columns)
    schema, settled = empty.schema, []
    while True:
        large = materialize(left.groupBy("doc", "snap").count().where(F.col("count") > group_edges).select("doc", "snap"))
        done = large.isEmpty()
        small = left if done else left.join(large, ["doc", "snap"], "left_anti")
        in_order = small.repartition("doc", "snap").sortWithinPartitions("doc", "snap", F.desc("sim"), "old_hash", "new_hash")
        settled.append(in_order.mapInArrow(_one_by_one, schema))
        if done:
            return reduce(DataFrame.unionByName, settled)
        now, left = _mutual_bests(left.join(large, ["doc", "snap"]))
        settled.append(now.select(*columns))


def snapshot_changes(
    snapshots: DataFrame, *, doc: Column, snap: Column, delivered: Column, number: Column, text: Column, score: Column,
    threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
) -> DataFrame:
    """``doc``, ``snap_no``, ``old_number``, ``new_number``, ``kind``: each change from a document's next lower snapshot to ``snap_no``.

    A full outer join on the primary key (document, comparison, number, canonical row hash) tells equal rows from those
    that miss a partner; what misses one is paired by equal hash, then by the similarity of the texts (distinct
    three-word sequences, at least ``threshold``, best first, one to one), and else is removed or added. ``changed``,
    ``moved``, ``rescored``, ``removed`` and ``added`` are as in TESTDATA.md; '' stands for a missing number.

    Defined results: of a snapshot delivered repeatedly only the latest delivery counts, a null delivery time being the
    earliest; repeated rows count once; rows with a null doc, snap, number or text do not count, though a delivery of
    such rows alone still is a snapshot; of equal rows with several scores the highest counts, NaN scores are unknown;
    copies of one text are paired in the order of their numbers; ties in similarity go to the smaller hash. A first snapshot and
    an empty table yield nothing. Texts without words have no similarity to others.
    """
    everything = snapshots.select(
        doc.alias("doc"), snap.alias("snap"), delivered.alias("delivered"), number.alias("number"), text.alias("text"),
        F.when(~F.isnan(score), score).alias("score"),
    ).where("doc IS NOT NULL AND snap IS NOT NULL")
    slim = everything.select("doc", "snap", "delivered", "number", row_hash(F.col("text")).alias("hash"), "score")
    kept, snaps = _current(slim)
    kept = materialize(kept)

    # ``own``: the snapshot that a row stands in; ``snap``: the later one of its comparison.
    new_side = kept.select("doc", "snap", "number", "hash", F.col("score").alias("new_score"), F.col("snap").alias("own_new"), F.lit(True).alias("is_new"))
    old_side = kept.where("next IS NOT NULL").select(
        "doc", F.col("next").alias("snap"), "number", "hash", F.col("score").alias("old_score"), F.col("snap").alias("own_old"), F.lit(True).alias("is_old")
    )
    joined = new_side.join(old_side, ["doc", "snap", "number", "hash"], "full_outer")
    differs = joined.where(f"is_old IS NULL OR is_new IS NULL OR abs(new_score - old_score) > {float(tolerance)!r}D")
    both = [F.coalesce("own_old", "own_new").alias("own"), F.col("is_old").isNotNull().alias("old"), F.col("is_new").isNotNull().alias("new")]
    differs = materialize(differs.select("doc", "snap", "number", "hash", *both))
    rescored = differs.where("old AND new").select("doc", "snap", F.col("number").alias("old_number"), F.col("number").alias("new_number"), F.lit("rescored").alias("kind"))

    # A document's first snapshot has nothing before it.
    later = snaps.where("next IS NOT NULL").select("doc", F.col("next").alias("snap"))
    unpaired = differs.where("old <> new").drop("new").join(later, ["doc", "snap"], "left_semi")
    placed = ordinals(unpaired, ["doc", "snap", "hash", "old"])
    by_text = placed.groupBy("doc", "snap", "hash", "k").agg(
        F.max(F.when(F.col("old"), F.col("number"))).alias("old_number"), F.max(F.when(~F.col("old"), F.col("number"))).alias("new_number"), F.max("own").alias("own")
    )
    by_text = materialize(by_text)
    moved = by_text.where("old_number IS NOT NULL AND new_number IS NOT NULL").select("doc", "snap", "old_number", "new_number", F.lit("moved").alias("kind"))

    # What is left of a text is on one side only; its copies are numbered from 0 again.
    single = by_text.where("old_number IS NULL OR new_number IS NULL").select(
        "doc", "snap", "hash", F.col("old_number").isNotNull().alias("old"), F.coalesce("old_number", "new_number").alias("number"), "k", "own"
    )
    classes = materialize(single.groupBy("doc", "snap", "hash", "old").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"), F.min(F.struct("own", "number")).alias("at")))
    # The texts come from one row of each class; only the rows under its key are hashed again.
    keys = classes.select("doc", F.col("at.own").alias("snap"), F.col("at.number").alias("number"), F.col("hash").alias("wanted"))
    wanted = F.broadcast(keys) if fits(keys, BROADCAST_ROWS) else keys
    source = everything.where("text IS NOT NULL").select("doc", "snap", "number", "text").join(wanted, ["doc", "snap", "number"])
    source = source.where(row_hash(F.col("text")) == F.col("wanted")).groupBy(F.col("wanted").alias("hash")).agg(F.min(canonical(F.col("text"))).alias("text"))
    grams = materialize(source.select("hash", words(F.col("text")).alias("w"))).select("hash", shingles(F.col("w")).alias("grams"))
    texts = materialize(classes.select("doc", "snap", "old", "hash").join(grams, "hash"))
    edges = similar_texts(texts, ["doc", "snap"], threshold)
    n_old = classes.where("old").select("doc", "snap", F.col("hash").alias("old_hash"), F.col("n").alias("n_old"))
    n_new = classes.where("NOT old").select("doc", "snap", F.col("hash").alias("new_hash"), F.col("n").alias("n_new"))
    pairs = greedy_pairs(edges.join(n_old, ["doc", "snap", "old_hash"]).join(n_new, ["doc", "snap", "new_hash"]))

    # The paired stretches of copies become single copies again.
    steps = pairs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).where("n > 0")
    copies = single.join(classes.select("doc", "snap", "hash", "old", "first"), ["doc", "snap", "hash", "old"]).withColumn("at", F.col("k") - F.col("first"))
    olds = copies.where("old").select("doc", "snap", F.col("hash").alias("old_hash"), F.col("at").alias("old_at"), F.col("number").alias("old_number"))
    news = copies.where("NOT old").select("doc", "snap", F.col("hash").alias("new_hash"), F.col("at").alias("new_at"), F.col("number").alias("new_number"))
    steps = steps.select("doc", "snap", "old_hash", "new_hash", (F.col("at_old") + F.col("i")).alias("old_at"), (F.col("at_new") + F.col("i")).alias("new_at"))
    rest = steps.join(olds, ["doc", "snap", "old_hash", "old_at"], "right").join(news, ["doc", "snap", "new_hash", "new_at"], "full_outer")
    kind = F.when(F.col("new_number").isNull(), "removed").when(F.col("old_number").isNull(), "added").otherwise("changed")
    rest = rest.select("doc", "snap", F.coalesce("old_number", F.lit("")).alias("old_number"), F.coalesce("new_number", F.lit("")).alias("new_number"), kind.alias("kind"))
    found = rescored.unionByName(moved).unionByName(rest)
    return found.select("doc", F.col("snap").alias("snap_no"), "old_number", "new_number", "kind")
