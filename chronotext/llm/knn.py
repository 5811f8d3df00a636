"""The most similar vectors of every vector, by multiprobe p-stable hashing and exact reranking.

Each of ``TABLES`` tables cuts ``k`` Gaussian (2-stable) projections of the unit vectors into slots of ``WIDTH``. A vector
is filed in its own bucket of each table and visits, besides it, the buckets that are most likely to hold its neighbours:
those across the nearest slot borders, in the order of the estimated success. What is met there is sieved by the distance
of signatures of random signs (with a margin) and then compared exactly.

``k`` grows with the logarithm of the largest group, so that the buckets stay about as full, and the number of tables with
the power ``GROWTH`` of it, as the theory of such tables has it. Recall is measured in tests against brute force.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.session import materialize
from chronotext.skew import fits, salted_join

WIDTH = 1.6
TABLES = 4
PROBES = 3
#: Rows that a bucket should hold, and the chance that two random unit vectors share a slot of WIDTH (measured).
OCCUPANCY = 22
SLOT_CHANCE = 0.426
GROWTH = 0.2
#: Bits of a signature, and how many standard deviations its distance may exceed that of the least similar pair wanted.
BITS, MARGIN = 192, 3.5
SEED = 20261127
#: Copies of one vector form a class; so many members of it (one more than TOP) are all that a neighbour can need.
TOP = 5
BROADCAST_ROWS = 200_000


def probe_sets(k: int, probes: int) -> list[tuple[int, ...]]:
    """The ``probes`` most promising sets of borders to cross, best first, as places in the order of border distances.

    Place j of 2k is the j-th nearest border of a vector; the expected square of its distance gives a set's score. A set may not
    cross both borders of one slot.
    """
    n = 2 * k
    expected = [j * (j + 1) / (4 * (k + 1) * (k + 2)) if j <= k else 1 - (n + 1 - j) / (k + 1) + (n + 1 - j) * (n + 2 - j) / (4 * (k + 1) * (k + 2)) for j in range(1, n + 1)]
    found: list[tuple[int, ...]] = []
    heap = [(expected[0], (0,))]
    while heap and len(found) < probes:
        score, places = heapq.heappop(heap)
        if not any(n - 1 - j in places for j in places):
            found.append(places)
        last = places[-1]
        if last + 1 < n:
            heapq.heappush(heap, (score - expected[last] + expected[last + 1], (*places[:-1], last + 1)))
            heapq.heappush(heap, (score + expected[last + 1], (*places, last + 1)))
    return found


def _buckets(unit: np.ndarray, group: np.ndarray, k: int, tables: int, probes: int) -> np.ndarray:
    """Bucket ids, shape (rows, tables, 1 + probes): the home bucket of each table and the probed ones."""
    rng = np.random.default_rng(SEED)
    axes, shift = rng.normal(size=(unit.shape[1], k * tables)), rng.uniform(0, WIDTH, k * tables)
    odd = rng.integers(1, 2**63, size=(tables, k), dtype=np.uint64) | np.uint64(1)
    place = (unit @ axes + shift) / WIDTH
    slot = np.floor(place)
    rest = place - slot
    out = np.empty((len(unit), tables, 1 + probes), np.uint64)
    crossings = probe_sets(k, probes) if probes else []
    for t in range(tables):
        cut = slice(t * k, (t + 1) * k)
        home = (slot[:, cut].astype(np.int64).astype(np.uint64) * odd[t]).sum(1, dtype=np.uint64) ^ (group.view(np.uint64) * np.uint64(2 * t + 3))
        out[:, t, 0] = home
        if crossings:
            order = np.argsort(np.concatenate([rest[:, cut], 1 - rest[:, cut]], 1), axis=1, kind="stable")
            step = odd[t][order % k] * np.where(order < k, np.uint64(2**64 - 1), np.uint64(1))
            base = (slot[:, cut].astype(np.int64).astype(np.uint64) * odd[t]).sum(1, dtype=np.uint64)
            for i, places in enumerate(crossings):
                out[:, t, 1 + i] = (base + step[:, list(places)].sum(1, dtype=np.uint64)) ^ (group.view(np.uint64) * np.uint64(2 * t + 3))
    return out


def _signatures(unit: np.ndarray) -> np.ndarray:
    """Signs of BITS random projections as BITS / 64 integers."""
    signs = unit @ np.random.default_rng(SEED + 1).normal(size=(unit.shape[1], BITS)) > 0
    return np.packbits(signs, axis=1).view(np.int64)


def _post(rows: DataFrame, k: int, tables: int, probes: int, home: bool) -> DataFrame:
    """``bucket``, ``id`` and the signature ``s0``, ...: where each vector is filed (``home``), or which buckets it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(n, -1)
            unit = values / np.abs(values).max(1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            ids, group = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "grp"))
            buckets = _buckets(unit, group, k, tables, 0 if home else probes).reshape(n, -1)
            marks = _signatures(unit)
            each = buckets.shape[1]
            yield pa.RecordBatch.from_pydict({
                "bucket": buckets.view(np.int64).ravel(), "id": np.repeat(ids, each),
                **{f"s{i}": np.repeat(marks[:, i], each) for i in range(BITS // 64)},
            })

    return rows.select("id", "grp", "embedding").mapInArrow(run, "bucket long, id long, " + ", ".join(f"s{i} long" for i in range(BITS // 64)))


def usable(cache: DataFrame, dims: int) -> DataFrame:
    """Rows whose vector has ``dims`` finite numbers, not all zero, and whose key has no null."""
    bad = "exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = float('inf'))"
    keys = "content_hash IS NOT NULL AND model_digest IS NOT NULL AND prefix IS NOT NULL"
    return cache.where(f"size(embedding) = {int(dims)} AND NOT {bad} AND exists(embedding, x -> x <> 0) AND {keys}")


def nearest(cache: DataFrame, *, dims: int = 64, top: int = TOP, min_cosine: float = 0.9) -> DataFrame:
    """``model_digest``, ``prefix``, ``hash_a`` < ``hash_b``: pairs in one model and prefix with cosine >= ``min_cosine`` of which one is among the other's ``top`` nearest.

    ``cache`` has content_hash, model_digest, prefix and embedding. Vectors of another length, all zero or with null, NaN
    or infinite parts are left out, as are rows with a null in their key; repeated rows count once. Equal vectors under
    several hashes are each other's nearest, the lowest hashes first, so that a class of them gives ``top`` pairs a member, never
    all. Ties in cosine go to the lower hash. An empty table gives no rows.
    """
    rows = usable(cache.select("content_hash", "model_digest", "prefix", "embedding"), dims)
    rows = rows.withColumns({
        "id": F.xxhash64("model_digest", "prefix", "content_hash"), "grp": F.xxhash64("model_digest", "prefix"),
        "v1": F.xxhash64("embedding"), "v2": F.hash("embedding"),
    })
    largest = rows.groupBy("grp").count().agg(F.max("count").alias("n")).first()["n"] or 1
    k = max(4, round(math.log(max(largest, OCCUPANCY + 1) / OCCUPANCY) / -math.log(SLOT_CHANCE)))
    tables = math.ceil(TABLES * max(1.0, (largest / 100_000) ** GROWTH))

    # Classes of equal vectors under several hashes; the member with the lowest hash stands for the class.
    same = ["grp", "v1", "v2"]
    several = materialize(rows.groupBy(*same).agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select(*same))
    side = F.broadcast(several) if fits(several, BROADCAST_ROWS) else several
    members = materialize(rows.join(side, same).select(*same, "model_digest", "prefix", "content_hash").distinct())
    place = F.row_number().over(Window.partitionBy(*same).orderBy("content_hash"))
    first = members.withColumn("place", place).where(f"place <= {top + 1}")
    first = first.groupBy(*same).agg(F.array_sort(F.collect_list("content_hash")).alias("names"))
    first = materialize(first.join(members.groupBy(*same).agg(F.count(F.lit(1)).alias("m")), same))
    names = F.broadcast(first) if fits(first, BROADCAST_ROWS) else first
    indexed = rows.join(names, same, "left").where("names IS NULL OR names[0] = content_hash")

    home = materialize(_post(indexed, k, tables, 0, home=True))
    visits = _post(indexed, k, tables, PROBES, home=False)
    filed = home.select("bucket", F.col("id").alias("other"), *[F.col(f"s{i}").alias(f"t{i}") for i in range(BITS // 64)])
    met = salted_join(visits, filed, ["bucket"], F.col("id"), sizes_of=home)
    chance = math.acos(min_cosine) / math.pi
    most = math.ceil(BITS * chance + MARGIN * math.sqrt(BITS * chance * (1 - chance)))
    apart = reduce(Column.__add__, [F.bit_count(F.expr(f"s{i} ^ t{i}")) for i in range(BITS // 64)])
    met = met.where((F.col("id") != F.col("other")) & (apart <= most))
    pairs = materialize(met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())

    # Exact cosines; only the vectors that met another one move.
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    ends = F.broadcast(ends) if fits(ends, BROADCAST_ROWS) else ends
    wanted = indexed.join(ends, "id", "left_semi").groupBy("id").agg(
        *[F.any_value(c).alias(c) for c in ("model_digest", "prefix", "embedding")],
        F.coalesce(F.any_value("names"), F.array(F.any_value("content_hash"))).alias("names"), F.coalesce(F.any_value("m"), F.lit(1)).alias("m"),
    )
    wide = "transform(embedding, x -> CAST(x AS DOUBLE))"
    wanted = wanted.withColumn("v", F.expr(wide)).drop("embedding")
    wanted = wanted.withColumn("norm", F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"))
    left = wanted.select(F.col("id").alias("a"), "model_digest", "prefix", *[F.col(c).alias(f"{c}_a") for c in ("v", "norm", "names", "m")])
    right = wanted.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("v", "norm", "names", "m")])
    near = pairs.join(left, "a").join(right, "b").withColumn("cosine", F.expr("aggregate(zip_with(v_a, v_b, (x, y) -> x * y), 0D, (s, x) -> s + x) / (norm_a * norm_b)"))
    near = materialize(near.where(F.col("cosine") >= min_cosine).select("a", "b", "model_digest", "prefix", "names_a", "names_b", "m_a", "m_b", "cosine"))

    # Both directions; copies of the asking vector have taken the first places already.
    there = near.select("model_digest", "prefix", F.col("a").alias("of"), F.col("names_a").alias("asking"), F.col("m_a").alias("m"), F.col("names_b").alias("found"), "cosine")
    back = near.select("model_digest", "prefix", F.col("b").alias("of"), F.col("names_b").alias("asking"), F.col("m_b").alias("m"), F.col("names_a").alias("found"), "cosine")
    asked = there.unionByName(back).where(f"m <= {top}").withColumn("y", F.explode("found"))
    rank = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("cosine"), "y"))
    across = asked.withColumn("rank", rank).where(f"rank <= {top}").where(f"rank <= {top} + 1 - m")
    across = across.select("model_digest", "prefix", F.explode("asking").alias("x"), "y")
    # Each copy with the first others of its class.
    mates = salted_join(members, first.select(*same, "names"), same, F.col("content_hash"))
    mates = mates.select("model_digest", "prefix", F.col("content_hash").alias("x"), F.explode(F.slice(F.array_remove("names", F.col("content_hash")), 1, top)).alias("y"))
    found = across.unionByName(mates).select("model_digest", "prefix", F.least("x", "y").alias("hash_a"), F.greatest("x", "y").alias("hash_b"))
    return found.where("hash_a <> hash_b").distinct()
