"""Ranked retrieval: exact vector and word search, fusion of ranks, candidate pools and reranking."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronotext.functions.text import words

RRF_K, RRF_DEPTH = 60, 50
#: Queries, and words of them, that are compared with all rows at once; more take several passes. Rows that a task compares at once.
QUERY_BLOCK, QUERY_TERMS, ROW_BLOCK = 4_096, 500_000, 512
# Words too common to search by.
STOPWORDS = "a an and are as at be but by can do does for from has have if in into is it its may no not of on or such that the their then there these they this to was when which will with would your you".split()


_WORD = re.compile(r"[a-z0-9']+")


def top(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each ``by`` in ``order`` (total) with their ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


class _Best:
    """The ``k`` lowest values of every query over the blocks seen so far, ties going to the lower id."""

    def __init__(self, queries: int, k: int, ids: type):
        self.k, self.values, self.ids = k, np.empty((queries, 0)), np.empty((queries, 0), ids)

    def add(self, values: np.ndarray, ids: np.ndarray) -> None:
        """``values`` (queries x rows, infinite for none) of the rows ``ids``."""
        values = np.concatenate([self.values, values], axis=1)
        if values.shape[1] > self.k:
            last = np.partition(values, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            at, column = np.nonzero((values <= last) & np.isfinite(values))
        else:
            at, column = np.nonzero(np.isfinite(values))
        held = self.values.shape[1]
        old = column < held
        names = np.empty(len(at), self.ids.dtype)
        names[old], names[~old] = self.ids[at[old], column[old]], ids[column[~old] - held]
        order = np.lexsort((np.unique(names, return_inverse=True)[1], values[at, column], at))
        at, column, names = at[order], column[order], names[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        few = place < self.k
        best = np.full((len(values), min(self.k, values.shape[1])), np.inf)
        found = np.zeros(best.shape, self.ids.dtype)
        best[at[few], place[few]], found[at[few], place[few]] = values[at, column][few], names[few]
        self.values, self.ids = best, found

    def batch(self, queries: list, kind: pa.DataType, q_kind: pa.DataType) -> pa.RecordBatch:
        at, place = np.nonzero(np.isfinite(self.values))
        names = pa.array(self.ids[at, place].tolist(), kind)
        return pa.RecordBatch.from_arrays([pa.array([queries[i] for i in at], q_kind), names, pa.array(self.values[at, place])], ["q", "c", "value"])


def _ids(column: pa.Array) -> tuple[np.ndarray, type]:
    kind = np.int64 if pa.types.is_integer(column.type) else object
    return np.array(column.to_pylist(), kind), kind


def cosine_top(chunks: DataFrame, queries: DataFrame, *, chunk_id: str, query_id: str, vector: str, k: int) -> DataFrame:
    """``query_id``, ``chunk_id``, ``distance`` (1 - cosine), ``rank``: the ``k`` nearest chunks of every query, exactly.

    Filter ``chunks`` first (as of a date, say): ranking comes after. Vectors of another length than the queries', null,
    zero or not finite ones are left out, as are null ids; a repeated row takes a place of its own. Ties go to the lower id. Queries are sent
    out in blocks of bounded size; a task compares a few rows at a time, keeps its ``k`` best of all and sends on those alone.
    """
    usable = f"{vector} IS NOT NULL AND size({vector}) > 0 AND NOT exists({vector}, x -> x IS NULL OR isnan(x) OR abs(x) = float('inf')) AND exists({vector}, x -> x <> 0)"
    asked = queries.where(usable).select(F.col(query_id).alias("q"), F.col(vector).alias("v")).where("q IS NOT NULL")
    rows = chunks.where(usable).select(F.col(chunk_id).alias("c"), F.col(vector).alias("v")).where("c IS NOT NULL")
    spark = chunks.sparkSession
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    kinds = f"q {asked.schema['q'].dataType.simpleString()}, c {rows.schema['c'].dataType.simpleString()}, value double"
    q_kind = to_arrow_type(asked.schema["q"].dataType)

    def search(block: int) -> DataFrame:
        part = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).orderBy("q").collect()
        shared = spark.sparkContext.broadcast(([r.q for r in part], [r.v for r in part]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, vectors = shared.value
            if not names:
                return
            width = len(vectors[0])
            unit = np.array(vectors, float)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            best, kind = None, None
            for batch in batches:
                lists = batch.column("v")
                right = np.flatnonzero(lists.value_lengths().to_numpy(zero_copy_only=False) == width)
                kind = batch.column("c").type
                for at in range(0, len(right), ROW_BLOCK):
                    some = pa.array(right[at : at + ROW_BLOCK])
                    x = lists.take(some).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                    ids, dtype = _ids(batch.column("c").take(some))
                    best = best or _Best(len(names), k, dtype)
                    best.add((1 - unit @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T).round(12), ids)
            if best:
                yield best.batch(names, kind, q_kind)

        return rows.mapInArrow(run, kinds)

    found = reduce(DataFrame.unionByName, [search(b) for b in range(blocks)])
    best = top(found, ["q"], [F.col("value"), F.col("c")], k)
    return best.select(F.col("q").alias(query_id), F.col("c").alias(chunk_id), F.col("value").alias("distance"), "rank")


def word_top(documents: DataFrame, queries: DataFrame, *, doc_id: str, query_id: str, text: str, k: int) -> DataFrame:
    """``query_id``, ``doc_id``, ``score``, ``rank``: documents that share words with a query.

    The query's words are ORed (stop words left out); the score is the number of their occurrences over 1 + ln(words of the
    document). Null and empty texts match nothing, null ids are left out, a repeated row takes a place of its own, ties go to the lower id.
    As in ``cosine_top`` the queries go out in blocks (of so many queries and words) and a task sends on its ``k`` best a query: pairs of
    query and document that share a word are counted where the document stands and never moved.
    """
    bare = F.filter(F.array_distinct(words(F.col(text))), lambda w: ~w.isin(STOPWORDS))
    asked = queries.select(F.col(query_id).alias("q"), bare.alias("terms")).where("q IS NOT NULL AND size(terms) > 0")
    rows = documents.select(F.col(doc_id).alias("c"), F.col(text).alias("t")).where("c IS NOT NULL AND t IS NOT NULL")
    spark = documents.sparkSession
    size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, math.ceil(size[0] / QUERY_BLOCK), math.ceil(size[1] / QUERY_TERMS))
    kinds = f"q {asked.schema['q'].dataType.simpleString()}, c {rows.schema['c'].dataType.simpleString()}, value double"
    q_kind = to_arrow_type(asked.schema["q"].dataType)

    def search(block: int) -> DataFrame:
        part = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).collect()
        by_query: dict = {}
        for row in part:
            by_query.setdefault(row.q, set()).update(row.terms)
        shared = spark.sparkContext.broadcast(sorted((q, sorted(terms)) for q, terms in by_query.items()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [q for q, _ in shared.value]
            asking: dict[str, list[int]] = {}
            for i, (_, terms) in enumerate(shared.value):
                for term in terms:
                    asking.setdefault(term, []).append(i)
            best, kind = None, None
            for batch in batches:
                kind = batch.column("c").type
                ids, dtype = _ids(batch.column("c"))
                best = best or _Best(len(names), k, dtype)
                column = batch.column("t")
                for at in range(0, len(ids), ROW_BLOCK):
                    # As ``words`` does; cut here, since sending each word would cost more than finding it.
                    texts = [_WORD.findall(t.replace("‘", "'").replace("’", "'").lower()) for t in column.slice(at, ROW_BLOCK).to_pylist()]
                    hits = np.zeros((len(names), len(texts)))
                    places: dict[str, tuple[list[int], list[int]]] = {}
                    for j, text_words in enumerate(texts):
                        for term, times in Counter(text_words).items():
                            if term in asking:
                                docs, counts = places.setdefault(term, ([], []))
                                docs.append(j)
                                counts.append(times)
                    for term, (docs, counts) in places.items():
                        hits[np.ix_(asking[term], docs)] += counts
                    scores = (hits / (1 + np.log([max(1, len(w)) for w in texts]))).round(9)
                    best.add(np.where(hits > 0, -scores, np.inf), ids[at : at + ROW_BLOCK])
            if best:
                yield best.batch(names, kind, q_kind)

        return rows.mapInArrow(run, kinds)

    found = reduce(DataFrame.unionByName, [search(b) for b in range(blocks)])
    best = top(found, ["q"], [F.col("value"), F.col("c")], k)
    return best.select(F.col("q").alias(query_id), F.col("c").alias(doc_id), (-F.col("value")).alias("score"), "rank")


def fuse(lists: Sequence[DataFrame], by: str, key: str, k: int, rrf_k: int = RRF_K, depth: int = RRF_DEPTH) -> DataFrame:
    """``by``, ``key``, ``score``, ``rank``: reciprocal rank fusion, the sum of 1 / (rrf_k + rank) over ranked lists.

    Each list has ``by``, ``key`` and ``rank``. Ties go to the earlier list, then the better rank in it.
    """
    rows = reduce(DataFrame.unionByName, [x.where(F.col("rank") <= depth).select(by, key, "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)])
    scored = rows.groupBy(by, key).agg(F.sum(1 / (F.lit(rrf_k) + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    best = top(scored, [by], [F.desc(F.round("score", 12)), F.col("first"), F.col(key)], k)
    return best.select(by, key, "score", "rank")


def pool(lists: Sequence[DataFrame], by: str, key: str) -> DataFrame:
    """``by``, ``key``, ``place``: the lists one after the other, each key where it came first."""
    rows = reduce(DataFrame.unionByName, [x.select(by, key, "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)])
    first = rows.groupBy(by, key).agg(F.min(F.struct("list", "rank")).alias("first"))
    return first.select(by, key, F.row_number().over(Window.partitionBy(by).orderBy("first", key)).alias("place"))


def rerank(pooled: DataFrame, score: Column, by: str, key: str, k: int) -> DataFrame:
    """``by``, ``key``, ``score``, ``rank``: the pool by descending score, ties in the pool's order. ``score`` may be a pandas UDF of a model."""
    best = top(pooled.withColumn("score", score), [by], [F.desc("score"), F.col("place")], k)
    return best.select(by, key, "score", "rank")


METHODS = ("naive", "as-of", "lexical", "hybrid", "rerank-vector", "rerank")
#: Candidates of each of two lists; of one list twice as many.
RERANK_DEPTH = 20


def retrieve(
    method: str, vector: Callable[[bool, int], DataFrame], lexical: Callable[[int], DataFrame], score: Column | None, by: str, key: str, k: int,
    add: Callable[[DataFrame], DataFrame] = lambda pooled: pooled,
) -> DataFrame:
    """One of METHODS over two searches: ``vector(as_of, k)`` and ``lexical(k)``. Unknown methods are refused.

    ``add`` joins to the pool (``by``, ``key``, ``place``) what ``score`` needs.
    """
    if method == "naive":
        return vector(False, k)
    if method == "as-of":
        return vector(True, k)
    if method == "lexical":
        return lexical(k)
    depth = max(k, RRF_DEPTH)
    if method == "hybrid":
        return fuse([vector(True, depth), lexical(depth)], by, key, k)
    if method in ("rerank-vector", "rerank") and score is not None:
        lists = [vector(True, RERANK_DEPTH), lexical(RERANK_DEPTH)] if method == "rerank" else [vector(True, 2 * RERANK_DEPTH)]
        return rerank(add(pool(lists, by, key)), score, by, key, k)
    raise ValueError(f"method: one of {', '.join(METHODS)} (rerank and rerank-vector need a score)")
