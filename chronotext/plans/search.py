"""Search of the passages and what comes of it: ranked lists, fusion, grades, comparisons of runs, signals and drift.

Every passage whose id is divisible by 20 is a question, asked with its vector and with its text; of the rules that it carries the references
in force on a day answer it, and other editions of the same rules are copies. The passage itself is never an answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions.text import words
from chronotext.operators import answers, drift, evaluate, retrieval, stats, temporal
from chronotext.plans.core import P4_SQL, p4_found
from chronotext.plans.registry import AS_OF, MODEL, OTHER_MODEL, OTHER_PREFIX, P_SQL, PREFIX, WORDS_SQL, Register, c, passages, table, wilson_sql

query = Register()
QUERIES, SQL = query.queries, query.sql
DEPTH = 20
_STOP = ", ".join(f"'{w}'" for w in retrieval.STOPWORDS)
_IN_FORCE = f"valid_from <= DATE '{AS_OF}' AND (valid_to IS NULL OR DATE '{AS_OF}' < valid_to)"

# --- lists ----------------------------------------------------------------------------------------------------------------


def _cache(spark: SparkSession, sf_dir: str, model: str = MODEL, prefix: str = PREFIX) -> DataFrame:
    """``content_hash``, ``embedding`` of the usable vectors of a model."""
    usable = "size(embedding) = 64 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = float('inf')) AND exists(embedding, x -> x <> 0)"
    rows = table(spark, sf_dir, "embedding_cache").where((c("model_digest") == model) & (c("prefix") == prefix)).where(usable)
    return rows.dropDuplicates(["content_hash"]).select("content_hash", "embedding")


def _cache_sql(name: str, model: str = MODEL, prefix: str = PREFIX) -> str:
    return f"""{name}_e AS (SELECT DISTINCT ON (content_hash) content_hash, embedding FROM embedding_cache WHERE model_digest = '{model}' AND prefix = '{prefix}' AND len(embedding) = 64
  AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
{name} AS (SELECT passage_id, kind, valid_from, valid_to, CAST(embedding AS DOUBLE[]) AS v FROM p JOIN {name}_e USING (content_hash))"""


def _in_force() -> F.Column:
    return temporal.in_force(F.lit(AS_OF).cast("date"), c("valid_from"), c("valid_to"))


def _vector_list(spark: SparkSession, sf_dir: str, as_of: bool, depth: int, itself: bool = False) -> DataFrame:
    held = passages(spark, sf_dir).join(_cache(spark, sf_dir), "content_hash").select("passage_id", "valid_from", "valid_to", "embedding")
    asked = held.where("passage_id % 20 = 0").select(c("passage_id").alias("q"), "embedding")
    found = retrieval.cosine_top(held.where(_in_force()) if as_of else held, asked, chunk_id="passage_id", query_id="q", vector="embedding", k=depth + 10)
    found = found if itself else found.where("passage_id <> q")
    return retrieval.top(found.drop("rank"), ["q"], [F.round("distance", 9), c("passage_id")], depth)


def _vector_sql(name: str, as_of: bool, itself: bool = False) -> str:
    where = "a.passage_id % 20 = 0" + (f" AND {_IN_FORCE.replace('valid_', 'b.valid_')}" if as_of else "") + ("" if itself else " AND a.passage_id <> b.passage_id")
    return f"""{name} AS (SELECT q, passage_id, d, row_number() OVER (PARTITION BY q ORDER BY round(d, 9), passage_id) AS rank FROM (
  SELECT a.passage_id AS q, b.passage_id, 1 - list_cosine_similarity(a.v, b.v) AS d FROM x a, x b WHERE {where}))"""


def _word_list(spark: SparkSession, sf_dir: str, as_of: bool, depth: int) -> DataFrame:
    rows = passages(spark, sf_dir)
    asked = rows.where("passage_id % 20 = 0").select(c("passage_id").alias("q"), "text")
    return retrieval.word_top((rows.where(_in_force()) if as_of else rows).select("passage_id", "text"), asked, doc_id="passage_id", query_id="q", text="text", k=depth)


def _word_sql(name: str, as_of: bool) -> str:
    return f"""{name}_w AS (SELECT passage_id, valid_from, valid_to, {WORDS_SQL} AS w FROM p), {name}_q AS (SELECT DISTINCT passage_id AS q, unnest(w) AS term FROM {name}_w WHERE passage_id % 20 = 0),
{name}_t AS (SELECT passage_id, len(w) AS n, unnest(w) AS term FROM {name}_w{f' WHERE {_IN_FORCE}' if as_of else ''}),
{name}_m AS (SELECT q, passage_id, n, count(*) AS hits FROM {name}_t JOIN {name}_q USING (term) WHERE term NOT IN ({_STOP}) GROUP BY ALL),
{name} AS (SELECT q, passage_id, row_number() OVER (PARTITION BY q ORDER BY round(hits / (1 + ln(n)), 9) DESC, passage_id) AS rank FROM {name}_m)"""


@query("""
WITH s AS (SELECT a.vec_id AS q, b.vec_id, 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT q, vec_id, rank, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(distance, 9), vec_id) AS rank FROM s) WHERE rank <= 5""")
def vector_topk_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other vectors of every vector whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = retrieval.cosine_top(rows, rows.where("vec_id % 20 = 0").select(c("vec_id").alias("q"), "embedding"), chunk_id="vec_id", query_id="q", vector="embedding", k=6)
    best = retrieval.top(found.where("vec_id <> q").drop("rank"), ["q"], [F.round("distance", 9), c("vec_id")], 5)
    return best.select("q", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@query(f"WITH {P_SQL}, {_cache_sql('x')}, {_vector_sql('a', True, True)} SELECT q, passage_id, rank FROM a WHERE rank <= 5")
def vector_topk_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest passages in force on a day: filtered first, then ranked."""
    return _vector_list(spark, sf_dir, True, 5, itself=True).select("q", "passage_id", "rank")


@query(f"""
WITH d AS (SELECT DISTINCT doc_id, text, {WORDS_SQL} AS w FROM documents), q AS (SELECT DISTINCT item_id, unnest({WORDS_SQL}) AS term FROM eval_items WHERE item_id % 20 = 0),
t AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d), m AS (SELECT item_id, doc_id, n, count(*) AS hits FROM t JOIN q USING (term) WHERE term NOT IN ({_STOP}) GROUP BY ALL)
SELECT item_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, hits / (1 + ln(n)) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(hits / (1 + ln(n)), 9) DESC, doc_id) AS rank FROM m) WHERE rank <= 10""")
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share the most words with an item."""
    asked = table(spark, sf_dir, "eval_items").where("item_id % 20 = 0").select("item_id", "text")
    found = retrieval.word_top(table(spark, sf_dir, "documents").select("doc_id", "text"), asked, doc_id="doc_id", query_id="item_id", text="text", k=10)
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _retrieved(spark: SparkSession, sf_dir: str, method: str, k: int) -> DataFrame:
    """A method over the passages in force on a day; the share of words in common stands in for a model's score."""

    def add(pooled: DataFrame) -> DataFrame:
        told = passages(spark, sf_dir).select("passage_id", F.array_distinct(words(c("text"))).alias("w"))
        return pooled.join(told, "passage_id").join(told.select(c("passage_id").alias("q"), c("w").alias("v")), "q")

    shared = F.coalesce(F.size(F.array_intersect("w", "v")) / F.nullif(F.size(F.array_union("w", "v")), F.lit(0)), F.lit(0.0))
    return retrieval.retrieve(
        method, lambda as_of, depth: _vector_list(spark, sf_dir, as_of, depth, itself=True), lambda depth: _word_list(spark, sf_dir, True, depth), F.round(shared, 9), "q", "passage_id", k, add
    )


_LISTS = f"{P_SQL}, {_cache_sql('x')}, {_vector_sql('a', True, True)}, {_word_sql('b', True)}"
_FUSED = """u AS (SELECT q, passage_id, rank, 0 AS l FROM a WHERE rank <= 50 UNION ALL SELECT q, passage_id, rank, 1 FROM b WHERE rank <= 50),
s AS (SELECT q, passage_id, sum(1 / (60 + rank)) AS score, min((l, rank)) AS f FROM u GROUP BY ALL)
SELECT q, passage_id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 12) DESC, f, passage_id) AS rank FROM s) WHERE rank <= 10"""
_POOLED = "u AS (SELECT q, passage_id, rank, 0 AS l FROM a WHERE rank <= 20 UNION ALL SELECT q, passage_id, rank, 1 FROM b WHERE rank <= 20), s AS (SELECT q, passage_id, min((l, rank)) AS f FROM u GROUP BY ALL)"


@query(f"WITH {_LISTS}, {_FUSED}")
def asof_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and word search of the passages in force, fused."""
    return _retrieved(spark, sf_dir, "hybrid", 10).select("q", "passage_id", F.round("score", 9).alias("score"), "rank")


@query(f"""
WITH {_LISTS}, {_POOLED}, d AS (SELECT passage_id, list_distinct(w) AS w FROM b_w),
j AS (SELECT s.*, round(coalesce(len(list_intersect(x.w, y.w)) / nullif(len(list_distinct(list_concat(x.w, y.w))), 0), 0), 9) AS score FROM s JOIN d x USING (passage_id) JOIN d y ON y.passage_id = q)
SELECT q, passage_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, f, passage_id) AS rank FROM j) WHERE rank <= 5""")
def asof_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of both searches by the share of words in common, in place of a model's score."""
    return _retrieved(spark, sf_dir, "rerank", 5).select("q", "passage_id", "rank")


@query(f"WITH {P_SQL}, {_cache_sql('x')}, {_vector_sql('a', False)}, {_word_sql('b', False)}, {_FUSED}")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector and word search of all passages, whatever the day, fused by reciprocal ranks."""
    fused = retrieval.fuse([_vector_list(spark, sf_dir, False, 50), _word_list(spark, sf_dir, False, 50)], "q", "passage_id", 10)
    return fused.select("q", "passage_id", F.round("score", 9).alias("score"), "rank")


@query(f"WITH {_LISTS}, {_POOLED} SELECT q, passage_id, row_number() OVER (PARTITION BY q ORDER BY f, passage_id) AS place FROM s")
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What either search of the passages in force finds, each once."""
    return retrieval.pool([_vector_list(spark, sf_dir, True, 20, itself=True), _word_list(spark, sf_dir, True, 20)], "q", "passage_id")


@query(f"""
WITH {_LISTS}, {_POOLED}, {_cache_sql('y', OTHER_MODEL, OTHER_PREFIX)},
j AS (SELECT s.*, coalesce(round(list_cosine_similarity(m.v, o.v), 9), -1) AS score FROM s LEFT JOIN y m USING (passage_id) LEFT JOIN y o ON o.passage_id = s.q)
SELECT q, passage_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, f, passage_id) AS rank FROM j) WHERE rank <= 5""")
def rerank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool by another model's vectors; what that model hasn't seen comes last, in the pool's order."""
    other = passages(spark, sf_dir).join(_cache(spark, sf_dir, OTHER_MODEL, OTHER_PREFIX), "content_hash").select("passage_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = candidate_pool(spark, sf_dir).join(other, "passage_id", "left").join(other.select(c("passage_id").alias("q"), c("v").alias("w")), "q", "left")
    dot = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    score = F.coalesce(F.round(dot / (norm(c("v")) * norm(c("w"))), 9), F.lit(-1.0))
    return retrieval.rerank(rows, score, "q", "passage_id", 5).select("q", "passage_id", "rank")


@query(f"""
WITH {P_SQL}, {_cache_sql('x')}, {_vector_sql('a', True)}, t AS (SELECT q, string_agg('[' || ref || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS body, count(*) AS blocks FROM a JOIN p USING (passage_id) WHERE rank <= 5 AND text IS NOT NULL GROUP BY q)
SELECT q, blocks, sha256('<retrieved_passages>' || chr(10) || body || chr(10) || '</retrieved_passages>' || chr(10) || chr(10) || 'Question: ' || o.text) AS prompt_sha256 FROM t JOIN p o ON o.passage_id = q""")
def retrieval_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each question over the five nearest passages in force, in rank order, as a digest."""
    rows = passages(spark, sf_dir).where("text IS NOT NULL")
    listed = _vector_list(spark, sf_dir, True, 5).join(rows.select("passage_id", "ref", c("text").alias("said")), "passage_id")
    blocks = listed.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", c("ref").alias("source_ref"), c("said").alias("text")))).alias("blocks"))
    asked = blocks.join(rows.select(c("passage_id").alias("q"), "text"), "q")
    return asked.select("q", F.size("blocks").cast("bigint").alias("blocks"), F.sha2(answers.prompt(c("text"), c("blocks")), 256).alias("prompt_sha256"))


# --- grades ---------------------------------------------------------------------------------------------------------------


def _carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each rule that a passage carries."""
    rows = passages(spark, sf_dir).withColumn("n", F.explode("refs"))
    return rows.select(
        "passage_id", "kind", F.concat_ws(":", "doc", "n").alias("rule"), F.concat(c("doc"), F.lit("@"), c("version"), F.lit(":"), c("n")).alias("ref"),
        c("content_hash").alias("text_hash"), _in_force().alias("in_effect"),
    )


def _graded(spark: SparkSession, sf_dir: str, as_of: bool) -> DataFrame:
    """``q``, ``kind``, ``answerable`` and the ranks of every question that has a vector."""
    carried = _carried(spark, sf_dir)
    rows = passages(spark, sf_dir)
    held = rows.join(_cache(spark, sf_dir).select("content_hash"), "content_hash", "left_semi")
    asked = held.where("passage_id % 20 = 0").select(c("passage_id").alias("q"), "kind")
    wanted = evaluate.expectations(carried.where("passage_id % 20 = 0").select(c("passage_id").alias("q"), "rule"), carried)
    questions = asked.join(wanted, "q", "left")
    told = rows.select("passage_id", evaluate.qualified(F.concat_ws("@", "doc", "version"), c("refs")).alias("refs"), F.coalesce(_in_force(), F.lit(False)).alias("now"))
    listed = _vector_list(spark, sf_dir, as_of, DEPTH).select("q", "passage_id", "rank").join(told, "passage_id").join(questions.select("q", "expect", "differing", "copies"), "q")
    carries = lambda refs: F.coalesce(F.arrays_overlap("refs", refs), F.lit(False))
    ranks = evaluate.grade(listed, ["q"], carries("expect"), carries("differing"), c("now"), carries("expect") | carries("copies"))
    return questions.select("q", "kind", (F.coalesce(F.size("expect"), F.lit(0)) > 0).alias("answerable")).join(ranks, "q", "left")


_RULES_SQL = f"""r AS (SELECT passage_id, kind, doc || ':' || n AS rule, doc || '@' || version || ':' || n AS ref, content_hash AS h, coalesce({_IN_FORCE}, false) AS now FROM (SELECT *, unnest(refs) AS n FROM p)),
k AS (SELECT DISTINCT a.passage_id AS q, r.ref, r.h, r.now FROM r a JOIN r USING (rule) WHERE a.passage_id % 20 = 0),
ex AS (SELECT DISTINCT q, ref FROM k WHERE now), cp AS (SELECT DISTINCT q, ref FROM k WHERE NOT now),
df AS (SELECT DISTINCT q, ref FROM k WHERE NOT now AND NOT EXISTS (SELECT 1 FROM k t WHERE t.now AND t.q = k.q AND t.h = k.h)),
asked AS (SELECT passage_id AS q, kind, EXISTS (SELECT 1 FROM ex WHERE ex.q = passage_id) AS answerable FROM x WHERE passage_id % 20 = 0)"""


def _graded_sql(name: str, as_of: bool) -> str:
    return f"""{_vector_sql(name + '_l', as_of)}, {name}_r AS (SELECT l.q, l.rank, r.now, EXISTS (SELECT 1 FROM ex WHERE ex.q = l.q AND ex.ref = r.ref) AS wanted, EXISTS (SELECT 1 FROM df WHERE df.q = l.q AND df.ref = r.ref) AS differs,
  EXISTS (SELECT 1 FROM cp WHERE cp.q = l.q AND cp.ref = r.ref) AS copied FROM {name}_l l JOIN r USING (passage_id) WHERE l.rank <= {DEPTH}),
{name} AS (SELECT q, any_value(kind) AS kind, any_value(answerable) AS answerable, min(rank) FILTER (WHERE now AND wanted) AS hit_rank, min(rank) FILTER (WHERE NOT now AND differs) AS outdated_rank,
  min(rank) FILTER (WHERE wanted OR copied) AS blind_rank FROM asked LEFT JOIN {name}_r USING (q) GROUP BY q)"""


_GRADED = f"WITH {P_SQL}, {_cache_sql('x')}, {_RULES_SQL}, {_graded_sql('g', True)}"
_NAIVE = f"WITH {P_SQL}, {_cache_sql('x')}, {_RULES_SQL}, {_graded_sql('h', False)}"
_BOTH = f"{_GRADED}, {_graded_sql('h', False)}"


@query(f"{_NAIVE} SELECT * FROM h")
def grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First ranks of hits, outdated copies and either, in a search that knows no date."""
    return _graded(spark, sf_dir, False)


_AT = ", ".join(f"count(*) FILTER (WHERE hit_rank <= {k}) AS hits_{k}" for k in evaluate.KS)


@query(f"{_GRADED} SELECT kind, count(*) AS n, {_AT}, " + ", ".join(f"round(count(*) FILTER (WHERE hit_rank <= {k}) / count(*), 9) AS recall_{k}" for k in evaluate.KS) + " FROM g WHERE answerable GROUP BY GROUPING SETS ((kind), ())")
def recall_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at several depths of the search as of a day, for each kind of question and for all."""
    rows = evaluate.recall_at(_graded(spark, sf_dir, True).where("answerable"), [["kind"], []])
    return rows.select("kind", "n", *[x for k in evaluate.KS for x in (f"hits_{k}", F.round(f"recall_{k}", 9).alias(f"recall_{k}"))])


_STALE = "outdated_rank <= 5 AND (hit_rank IS NULL OR outdated_rank < hit_rank)"


@query(f"{_NAIVE}, s AS (SELECT kind, count(*)::DOUBLE AS n, count(*) FILTER (WHERE {_STALE})::DOUBLE AS k FROM h GROUP BY kind) SELECT kind, n::BIGINT AS n, k::BIGINT AS stale, {wilson_sql('k', 'n')} FROM s")
def stale_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a search that knows no date puts an outdated copy above the hit."""
    rows = evaluate.stale_above(_graded(spark, sf_dir, False), ["kind"])
    return rows.select("kind", "n", "stale", F.round("interval.low", 6).alias("low"), F.round("interval.high", 6).alias("high"))


_MCNEMAR = """round(CASE WHEN gained + lost = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(gained, lost) + 1),
  lambda i: exp(lgamma(gained + lost + 1) - lgamma(i + 1) - lgamma(gained + lost - i + 1) - (gained + lost) * ln(2))))) END, 9) AS p"""


@query(f"""{_BOTH}, x5 AS (SELECT coalesce(h.hit_rank <= 5, false) AS a, coalesce(g.hit_rank <= 5, false) AS b FROM g JOIN h USING (q)),
s5 AS (SELECT count(*) AS n, count(*) FILTER (WHERE b AND NOT a) AS gained, count(*) FILTER (WHERE a AND NOT b) AS lost FROM x5) SELECT n, gained, lost, {_MCNEMAR} FROM s5""")
def paired_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search without and with the date on the same questions: gained, lost, exact McNemar."""
    rows = evaluate.compare(_graded(spark, sf_dir, False), _graded(spark, sf_dir, True), "q", [])
    return rows.select("n", "gained", "lost", F.round("p", 9).alias("p"))


@query(f"""{_BOTH}, y AS (SELECT g.kind, g.hit_rank, g.outdated_rank, coalesce(g.hit_rank <= 5, false) AS b, coalesce(h.hit_rank <= 5, false) AS a FROM g JOIN h USING (q)),
s5 AS (SELECT kind, count(*) AS n, {_AT}, count(*) FILTER (WHERE {_STALE}) AS stale, count(*) FILTER (WHERE b AND NOT a) AS gained, count(*) FILTER (WHERE a AND NOT b) AS lost FROM y GROUP BY GROUPING SETS ((kind), ()))
SELECT * EXCLUDE (gained, lost), gained, lost, {_MCNEMAR} FROM s5""")
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search as of a day in one row a kind: hits, outdated copies, and what it gains and loses against the one without."""
    rows = evaluate.run_entry(_graded(spark, sf_dir, True), _graded(spark, sf_dir, False), "q", [["kind"], []])
    return rows.withColumn("p", F.round("p", 9))


_KINDS = ["below-cutoff", "card-not-in-corpus", "rule-only", "unclassified"]
_MISS = "CASE WHEN NOT answerable THEN 'unclassified' WHEN hit_rank <= 5 THEN NULL WHEN hit_rank IS NOT NULL THEN 'below-cutoff' WHEN kind = 'card' THEN 'card-not-in-corpus' WHEN kind = 'rule' THEN 'rule-only' ELSE 'unclassified' END"


@query(f"{_GRADED}, m AS (SELECT kind, {_MISS} AS why FROM g) SELECT kind, " + ", ".join(f"count(*) FILTER (WHERE why = '{k}') AS \"{k}\"" for k in _KINDS) + ", count(*) AS total, grouping(kind) = 1 AS is_total FROM m GROUP BY GROUPING SETS ((kind), ())")
def miss_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why questions missed, by kind and for all, zeros included."""
    category = F.when(c("kind") == "card", "cards").when(c("kind") == "rule", "mechanics")
    rows = _graded(spark, sf_dir, True).withColumn("why", evaluate.miss_category(c("answerable"), c("hit_rank"), category))
    return evaluate.crosstab(rows, "kind", "why", _KINDS, total_row=True)


@query(f"{_BOTH} SELECT coalesce(g.q, h.q) AS q, CASE WHEN h.q IS NULL THEN 'only_a' WHEN g.q IS NULL THEN 'only_b' ELSE 'both' END AS state, g.hit_rank AS hit_rank_a, h.hit_rank AS hit_rank_b FROM (SELECT * FROM g WHERE hit_rank IS NOT NULL) g FULL JOIN (SELECT * FROM h WHERE hit_rank IS NOT NULL) h USING (q)")
def paired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of the search with and without the date matched, with those that only one has."""
    rows = evaluate.paired(_graded(spark, sf_dir, True).where("hit_rank IS NOT NULL"), _graded(spark, sf_dir, False).where("hit_rank IS NOT NULL"), "q", ["hit_rank"])
    return rows.select("q", "state", "hit_rank_a", "hit_rank_b")


# --- drift ----------------------------------------------------------------------------------------------------------------

_NUMBERED = "CAST(regexp_extract(candidate_id, '([0-9]+)$', 1) AS BIGINT) % 20 = 0"


def _fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What word search without dates answers to the candidates whose number is divisible by 20."""
    asked = table(spark, sf_dir, "candidates").where(_NUMBERED).dropDuplicates(["candidate_id"]).select("candidate_id", "question", "as_of", "current_refs", "stale_refs")
    rows = passages(spark, sf_dir)
    found = retrieval.word_top(rows.select("passage_id", "text"), asked.select("candidate_id", "question").withColumnRenamed("question", "text"), doc_id="passage_id", query_id="candidate_id", text="text", k=5)
    told = rows.select("passage_id", "content_hash", "valid_from", "valid_to", c("ref").alias("source_ref"), evaluate.qualified(F.concat_ws("@", "doc", "version"), c("refs")).alias("refs"))
    ranked = found.join(told, "passage_id").join(asked.select("candidate_id", "as_of"), "candidate_id")
    ranked = ranked.withColumns({"in_effect": temporal.in_force(c("as_of"), c("valid_from"), c("valid_to")), "distance": -c("score")})
    return drift.fixtures(asked, ranked, "candidate_id")


_FIXTURES = f"""{P_SQL}, k AS (SELECT DISTINCT ON (candidate_id) candidate_id, question, as_of, coalesce(current_refs, []) AS current_refs, coalesce(stale_refs, []) AS stale_refs, current_refs IS NULL AS bare FROM candidates WHERE {_NUMBERED}),
kq AS (SELECT DISTINCT candidate_id, unnest({WORDS_SQL.replace('(text,', '(question,')}) AS term FROM k), pw AS (SELECT passage_id, {WORDS_SQL} AS w FROM p), pt AS (SELECT passage_id, len(w) AS n, unnest(w) AS term FROM pw),
km AS (SELECT candidate_id, passage_id, n, count(*) AS hits FROM pt JOIN kq USING (term) WHERE term NOT IN ({_STOP}) GROUP BY ALL),
kl AS (SELECT candidate_id, passage_id, row_number() OVER (PARTITION BY candidate_id ORDER BY round(hits / (1 + ln(n)), 9) DESC, passage_id) AS rank FROM km),
kr AS (SELECT candidate_id, rank, list_transform(refs, lambda x: doc || '@' || version || ':' || x) AS refs FROM kl JOIN p USING (passage_id) WHERE rank <= 5),
f AS (SELECT candidate_id, min(rank) FILTER (WHERE list_has_any(refs, current_refs)) AS first_current_rank, min(rank) FILTER (WHERE list_has_any(refs, stale_refs)) AS first_stale_rank, count(rank) AS results,
  coalesce(bool_or(rank = 1 AND list_has_any(refs, stale_refs)), false) AS s, coalesce(bool_or(rank = 1 AND list_has_any(refs, current_refs)), false) AS t FROM k LEFT JOIN kr USING (candidate_id) GROUP BY candidate_id),
v AS (SELECT *, CASE WHEN s THEN 'captured' WHEN t THEN 'not captured' ELSE 'inconclusive' END AS verdict FROM f)"""


@query(f"WITH {_FIXTURES} SELECT candidate_id, first_current_rank, first_stale_rank, results, verdict FROM v")
def drift_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches without dates kept as evidence: the verdict on the first result, and where current and stale texts came."""
    rows = _fixtures(spark, sf_dir)
    return rows.select("candidate_id", "first_current_rank", "first_stale_rank", F.coalesce(F.size("results"), F.lit(0)).cast("bigint").alias("results"), "verdict")


@query(f"""
WITH {_FIXTURES}, found AS ({P4_SQL}), labels AS (SELECT candidate_id, list_transform(refs, lambda x: doc || '@' || version || ':' || x) AS now_refs FROM found JOIN p USING (passage_id)),
z AS (SELECT v.candidate_id, v.verdict AS recorded, CASE WHEN l.candidate_id IS NULL THEN 'no candidate' WHEN list_has_any(kr.refs, l.now_refs) THEN 'not captured' ELSE 'inconclusive' END AS now
  FROM v LEFT JOIN labels l USING (candidate_id) LEFT JOIN (SELECT * FROM kr WHERE rank = 1) kr USING (candidate_id))
SELECT candidate_id, recorded, now, recorded <> now AS changed FROM z""")
def drift_regraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same evidence under labels made from what was known on each day, without another search."""
    told = passages(spark, sf_dir).select("passage_id", evaluate.qualified(F.concat_ws("@", "doc", "version"), c("refs")).alias("current_refs"))
    labels = p4_found(spark, sf_dir).join(told, "passage_id").select("candidate_id", "current_refs", F.array().cast("array<string>").alias("stale_refs"))
    return drift.regraded(_fixtures(spark, sf_dir), labels, "candidate_id")


@query(f"""
WITH {P_SQL}, known AS (SELECT DISTINCT doc || '@' || version || ':' || n AS ref FROM (SELECT doc, version, unnest(refs) AS n FROM p)), k AS (SELECT DISTINCT candidate_id, current_refs FROM candidates),
m AS (SELECT DISTINCT candidate_id, ref FROM (SELECT candidate_id, unnest(current_refs) AS ref FROM k) WHERE ref IS NOT NULL AND ref NOT IN (SELECT ref FROM known WHERE ref IS NOT NULL))
SELECT candidate_id, 'no expected sources' AS fault, '' AS missing FROM k WHERE coalesce(len(current_refs), 0) < 1 UNION ALL SELECT candidate_id, 'refs not in the corpus', string_agg(ref, ' ' ORDER BY ref) FROM m GROUP BY 1""")
def label_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that expect nothing, or references that no passage carries."""
    known = passages(spark, sf_dir).select(F.explode(evaluate.qualified(F.concat_ws("@", "doc", "version"), c("refs"))).alias("ref"))
    rows = drift.label_faults(table(spark, sf_dir, "candidates").select("candidate_id", "current_refs"), "candidate_id", "current_refs", known, "ref")
    return rows.select("candidate_id", "fault", F.array_join("missing", " ").alias("missing"))


@query("""
WITH k AS (SELECT DISTINCT candidate_id, lower(trim(split_part(about, ':', 1), ' ')) AS doc, len(list_intersect(current_refs, stale_refs)) > 0 AS bad FROM candidates)
SELECT doc, count(DISTINCT candidate_id) AS checked, count(DISTINCT candidate_id) FILTER (WHERE bad) AS faulty FROM k GROUP BY doc""")
def candidate_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates of each document call a reference current and stale at once."""
    rows = table(spark, sf_dir, "candidates")
    doc = F.lower(F.trim(F.substring_index("about", ":", 1))).alias("doc")
    bad = drift.candidate_faults(rows, "candidate_id").select("candidate_id", F.lit(True).alias("bad"))
    both = rows.select("candidate_id", doc).distinct().join(bad, "candidate_id", "left")
    return both.groupBy("doc").agg(F.countDistinct("candidate_id").alias("checked"), F.countDistinct(F.when(c("bad"), c("candidate_id"))).alias("faulty"))


# --- signals --------------------------------------------------------------------------------------------------------------

_RULED = "CAST(regexp_extract(ruling_id, '([0-9]+)$', 1) AS BIGINT) % 20 = 0"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gen_id``, ``done_reason`` and the nine signals of the answers to the rulings whose number is divisible by 20."""
    asked = table(spark, sf_dir, "rulings").where(f"{_RULED} AND question IS NOT NULL").dropDuplicates(["ruling_id"]).select("ruling_id", c("question").alias("text"), "created")
    rows = passages(spark, sf_dir)
    found = retrieval.word_top(rows.select("passage_id", "text"), asked, doc_id="passage_id", query_id="ruling_id", text="text", k=5)
    told = rows.select("passage_id", c("ref").alias("source_ref"), evaluate.qualified(F.concat_ws("@", "doc", "version"), c("refs")).alias("refs"))
    one = F.struct("rank", "source_ref", "refs", (-c("score")).alias("distance"))
    lists = found.join(told, "passage_id").groupBy("ruling_id").agg(F.array_sort(F.collect_list(one)).alias("l"))
    # A registry: one entry an edition.
    registry = rows.groupBy("doc", "version").agg(F.min("valid_from").alias("effective"), F.min("published_at").alias("printed"))
    windows = temporal.validity_windows(registry, ["doc"], "version", "effective", "printed").where("valid_from IS NOT NULL")
    entries = F.collect_list(F.struct(F.concat_ws("@", "doc", "version").alias("k"), F.struct("valid_from", "valid_to").alias("w")))
    held = windows.agg(F.map_from_entries(entries).alias("w")).scalar()

    def holds(edition: F.Column) -> F.Column:
        window = F.try_element_at(c("windows"), edition)
        return temporal.in_force(c("created"), window["valid_from"], window["valid_to"])

    answered = table(spark, sf_dir, "generations").where("text IS NOT NULL").dropDuplicates(["gen_id"]).join(asked.drop("text"), "ruling_id").join(lists, "ruling_id", "left").withColumn("windows", held)
    of = lambda field: F.coalesce(F.transform("l", lambda x: x[field]), F.array())
    refs = F.flatten(F.transform(F.coalesce("l", F.array().cast(lists.schema["l"].dataType)), lambda x: x["refs"]))
    return answered.select("gen_id", "done_reason", *answers.signals(c("text"), c("answer_tokens"), of("source_ref"), refs, of("distance"), holds))


_CITES = r"list_sort(list_distinct(regexp_extract_all(text, 'core@\d+\.\d+:\d{3}(?:\.[0-9a-z]+)*')))"
_ABSTAINS = r"regexp_matches(text, '(?i)\b(?:do(?:es)? not|don''t|doesn''t) (?:answer|contain|cover|address|specify|say|mention)|not (?:enough|sufficient) information|cannot be determined|no information')"


@query(f"""
WITH {P_SQL}, k AS (SELECT DISTINCT ON (ruling_id) ruling_id, question AS text, created FROM rulings WHERE {_RULED} AND question IS NOT NULL), kq AS (SELECT DISTINCT ruling_id, unnest({WORDS_SQL}) AS term FROM k),
pw AS (SELECT passage_id, {WORDS_SQL} AS w FROM p), pt AS (SELECT passage_id, len(w) AS n, unnest(w) AS term FROM pw), km AS (SELECT ruling_id, passage_id, n, count(*) AS hits FROM pt JOIN kq USING (term) WHERE term NOT IN ({_STOP}) GROUP BY ALL),
kl AS (SELECT ruling_id, passage_id, round(hits / (1 + ln(n)), 9) AS score, row_number() OVER (PARTITION BY ruling_id ORDER BY round(hits / (1 + ln(n)), 9) DESC, passage_id) AS rank FROM km),
l AS (SELECT ruling_id, list(ref ORDER BY rank) AS refs, list(-score ORDER BY rank) AS d, list_distinct(flatten(list(list_transform(refs, lambda x: doc || '@' || version || ':' || x)))) AS all_refs, count(DISTINCT version) AS versions
  FROM (SELECT * FROM kl WHERE rank <= 5) JOIN p USING (passage_id) GROUP BY ruling_id),
v AS (SELECT doc, version, min(valid_from) AS e, min(published_at) AS pr FROM p GROUP BY ALL),
w AS (SELECT *, lead(e) OVER o AS nx, lead(1) OVER o IS NULL AS last FROM v WINDOW o AS (PARTITION BY doc ORDER BY list_transform(string_split(version, '.'), lambda x: try_cast(x AS INT)), version)),
win AS (SELECT doc || '@' || version AS ed, e AS a, nx AS b FROM w WHERE e IS NOT NULL AND e >= pr AND (last OR nx > e)),
g AS (SELECT DISTINCT ON (gen_id) * FROM generations WHERE text IS NOT NULL), j AS (SELECT g.gen_id, g.text, g.answer_tokens, k.created, l.*, {_CITES.replace('text', 'g.text')} AS cites FROM g JOIN k USING (ruling_id) LEFT JOIN l USING (ruling_id)),
ce AS (SELECT gen_id, bool_and(EXISTS (SELECT 1 FROM win WHERE ed = split_part(cite, ':', 1) AND a <= created AND (b IS NULL OR created < b))) AS fine FROM (SELECT gen_id, created, unnest(cites) AS cite FROM j) GROUP BY gen_id),
te AS (SELECT gen_id, EXISTS (SELECT 1 FROM win WHERE ed = split_part(refs[1], ':', 1) AND a <= created AND (b IS NULL OR created < b)) AS fine FROM j)
SELECT j.gen_id, round(coalesce(d[1], 1), 6) AS top_distance, round(coalesce(d[2] - d[1], 0), 6) AS margin, te.fine::INT::DOUBLE AS top_in_effect, (coalesce(versions, 0) > 1)::INT::DOUBLE AS versions_disagree, (len(cites) > 0)::INT::DOUBLE AS cites_any,
  (len(cites) > 0 AND coalesce(list_has_all(all_refs, cites), false))::INT::DOUBLE AS cites_only_retrieved, (len(cites) > 0 AND coalesce(ce.fine, true))::INT::DOUBLE AS cites_only_in_effect, {_ABSTAINS}::INT::DOUBLE AS abstains,
  round(ln(1 + answer_tokens), 6) AS log_answer_tokens FROM j LEFT JOIN ce USING (gen_id) LEFT JOIN te USING (gen_id)""")
def confidence_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine signals of every such answer."""
    rows = _signals(spark, sf_dir)
    return rows.select("gen_id", *[F.round(s, 6).alias(s) if s in ("top_distance", "margin", "log_answer_tokens") else c(s) for s in answers.SIGNALS])


@query(f"""
WITH {P_SQL}, found AS ({P4_SQL}), k AS (SELECT DISTINCT ON (candidate_id) candidate_id, question FROM candidates), b AS (SELECT candidate_id, question, ref, text FROM found JOIN k USING (candidate_id) JOIN p USING (passage_id)),
a AS (SELECT * FROM (VALUES {', '.join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in answers.ATTACKS.items())}) t(attack, bait)),
x AS (SELECT *, '[{answers.PLANTED_REF}]' || chr(10) || bait || chr(10) || chr(10) || '[' || ref || ']' || chr(10) || text AS bare, chr(10) || '</retrieved_passages>' || chr(10) || chr(10) || 'Question: ' || question AS tail FROM b, a),
y AS (SELECT *, '{answers.FRAME}' || '<retrieved_passages>' || chr(10) || bare || tail AS framed FROM x),
z AS (SELECT candidate_id, attack, unnest(['naive', 'framed', 'sandwich', 'datamarking', 'escaped']) AS defence, unnest(['Passages:' || chr(10) || bare || chr(10) || chr(10) || 'Question: ' || question, framed, framed || '{answers.REMINDER}',
  '{answers.FRAME}{answers.MARKED}<retrieved_passages>' || chr(10) || '[{answers.PLANTED_REF}]' || chr(10) || replace(bait, ' ', '{answers.MARK}') || chr(10) || chr(10) || '[' || ref || ']' || chr(10) || replace(text, ' ', '{answers.MARK}') || tail,
  '{answers.FRAME}<retrieved_passages>' || chr(10) || '[{answers.PLANTED_REF}]' || chr(10) || regexp_replace(bait, '<\\s*/?\\s*retrieved_passages\\s*>', '[delimiter removed]', 'gi') || chr(10) || chr(10) || '[' || ref || ']' || chr(10) || regexp_replace(text, '<\\s*/?\\s*retrieved_passages\\s*>', '[delimiter removed]', 'gi') || tail]) AS prompt FROM y)
SELECT candidate_id, attack, defence, sha256(prompt) AS prompt_sha256 FROM z""")
def injection_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases of the injection test as digests of their prompts: every candidate with a passage, each attack planted before it, each defence."""
    asked = table(spark, sf_dir, "candidates").dropDuplicates(["candidate_id"]).select("candidate_id", "question")
    rows = p4_found(spark, sf_dir).join(asked, "candidate_id").join(passages(spark, sf_dir).select("passage_id", "ref", "text"), "passage_id").where("text IS NOT NULL AND question IS NOT NULL")
    grid = answers.injection_grid(rows.select("candidate_id", "question", F.array(F.struct(c("ref").alias("source_ref"), "text")).alias("blocks")))
    prompt = answers.defended_prompt(c("question"), answers.planted(c("blocks"), c("attack")), c("defence"))
    return grid.select("candidate_id", "attack", "defence", F.sha2(prompt, 256).alias("prompt_sha256"))


@query()
def confidence_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the nine signals foretell, out of fold, that an answer ended by itself: calibration of the logistic scores."""
    rows = _signals(spark, sf_dir).where("done_reason IS NOT NULL").withColumn("y", (c("done_reason") == "stop").cast("int"))
    scored = stats.out_of_fold(rows, "gen_id", answers.SIGNALS, "y")
    return stats.calibration(scored, "gen_id", "probability", "y")


_SAVED = {"weights": {"margin": -0.4, "cites_any": 0.9, "abstains": -1.1, "log_answer_tokens": 0.3}, "mean": {"margin": 0.1, "cites_any": 0.5, "abstains": 0.05, "log_answer_tokens": 3.5}, "std": {"margin": 0.2, "cites_any": 0.5, "abstains": 0.2, "log_answer_tokens": 0.6}}


@query(rf"""
WITH g AS (SELECT DISTINCT ON (gen_id) * FROM generations WHERE text IS NOT NULL AND answer_tokens IS NOT NULL),
x AS (SELECT gen_id, (len(regexp_extract_all(text, 'core@\d+\.\d+:\d{{3}}(?:\.[0-9a-z]+)*')) > 0)::INT AS a, {_ABSTAINS}::INT AS b, ln(1 + answer_tokens) AS c FROM g)
SELECT gen_id, round(1 / (1 + exp(-(0.2 + 0.9 * (a - 0.5) / 0.5 - 1.1 * (b - 0.05) / 0.2 + 0.3 * (c - 3.5) / 0.6))), 6) AS probability FROM x""")
def saved_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer scored by saved weights of signals that its text tells by itself."""
    rows = table(spark, sf_dir, "generations").dropDuplicates(["gen_id"]).where("text IS NOT NULL AND answer_tokens IS NOT NULL")
    none = F.array().cast("array<string>")
    told = rows.select("gen_id", *answers.signals(c("text"), c("answer_tokens"), none, none, F.array().cast("array<double>"), lambda edition: F.lit(False)))
    names = ("cites_any", "abstains", "log_answer_tokens")
    score = stats.predicted({n: _SAVED["weights"][n] for n in names}, 0.2, _SAVED["mean"], _SAVED["std"])
    return told.select("gen_id", F.round(score, 6).alias("probability"))
