"""Registered queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm import defects, knn, leaks, neardup, tokens, toxicity


def _rule_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rules = spark.read.parquet(f"{sf_dir}/rules.parquet")
    return neardup.text_classes(rules, row_id=F.col("rule_id"), text=neardup.without_number(F.col("text"), F.col("number")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rules whose texts are near copies."""
    members, classes = _rule_classes(spark, sf_dir)
    found = neardup.near_copies(members, neardup.class_pairs(classes))
    return found.select(F.col("a").alias("rule_a"), F.col("b").alias("rule_b"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a rule: its class of equal texts and the number of similar classes."""
    members, classes = _rule_classes(spark, sf_dir)
    report = neardup.copy_report(members, neardup.class_pairs(classes))
    return report.select(F.col("id").alias("rule_id"), "class_id", "links")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of content hashes whose vectors are among each other's most similar."""
    return knn.nearest(spark.read.parquet(f"{sf_dir}/embedding_cache.parquet"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id=F.col("doc_id"), text=F.col("text"))


def _leak_inputs(spark: SparkSession, sf_dir: str) -> dict:
    return {
        "documents": spark.read.parquet(f"{sf_dir}/documents.parquet"), "items": spark.read.parquet(f"{sf_dir}/eval_items.parquet"),
        "doc_id": F.col("doc_id"), "text": F.col("text"), "item_id": F.col("item_id"), "item_text": F.col("text"),
    }


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of held-out items."""
    return leaks.leaks(**_leak_inputs(spark, sf_dir))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where those passages stand in the documents."""
    return leaks.leak_spans(**_leak_inputs(spark, sf_dir))


def p2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every generation with all its defects and their posteriors."""
    return defects.defects(spark.read.parquet(f"{sf_dir}/generations.parquet"), spark.read.parquet(f"{sf_dir}/rulings.parquet"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective generations with the first defect that fits."""
    return p2_labels(spark, sf_dir).where("size(labels) > 0").select("gen_id", F.col("labels")[0].alias("defect"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score for abusive content; from 0 on it is a case."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity.scored(documents, spark.read.parquet(f"{sf_dir}/doc_labels.parquet"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexual passages."""
    return p8_scores(spark, sf_dir).where("score >= 0").select("doc_id").distinct()


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of such documents in every source."""
    return toxicity.rates(p8_scores(spark, sf_dir))


_HEAD = r"^[\s\pZ]*[\[({]?[\s\pZ]*([A-Za-z0-9]+(?:\.[A-Za-z0-9]+)*)\.?[\s\pZ]*[\])}]?[.:]?(?:[\s\pZ]|$)"

P1_SQL = f"""
WITH t AS (SELECT DISTINCT rule_id, number, text FROM rules WHERE text IS NOT NULL AND rule_id IS NOT NULL),
s AS (SELECT rule_id, CASE WHEN lower(regexp_extract(text, '{_HEAD}', 1)) = lower(trim(number)) THEN regexp_replace(text, '{_HEAD}', '') ELSE text END AS x FROM t),
w AS (SELECT rule_id, regexp_extract_all(lower(replace(replace(x, chr(8216), chr(39)), chr(8217), chr(39))), '[a-z0-9' || chr(39) || ']+') AS w FROM s),
i AS (SELECT rule_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 12),
g AS (SELECT DISTINCT rule_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM i), n AS (SELECT rule_id, count(*) AS n FROM g GROUP BY rule_id),
p AS (SELECT a.rule_id AS a, b.rule_id AS b, count(*) AS c FROM g a JOIN g b USING (g) WHERE a.rule_id < b.rule_id GROUP BY ALL)
SELECT a AS rule_a, b AS rule_b FROM p JOIN n x ON x.rule_id = a JOIN n y ON y.rule_id = b WHERE c / (x.n + y.n - c) >= 0.5
"""

P1_CLASSES_SQL = f"""
WITH t AS (SELECT DISTINCT rule_id, number, text FROM rules WHERE text IS NOT NULL AND rule_id IS NOT NULL),
s AS (SELECT rule_id, CASE WHEN lower(regexp_extract(text, '{_HEAD}', 1)) = lower(trim(number)) THEN regexp_replace(text, '{_HEAD}', '') ELSE text END AS x FROM t),
w AS (SELECT rule_id, regexp_extract_all(lower(replace(replace(x, chr(8216), chr(39)), chr(8217), chr(39))), '[a-z0-9' || chr(39) || ']+') AS w FROM s),
e AS (SELECT rule_id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS set FROM w WHERE len(w) >= 12),
k AS (SELECT set, min(rule_id) AS class_id, row_number() OVER () AS c FROM e GROUP BY set), g AS (SELECT c, len(set) AS n, unnest(set) AS g FROM k),
p AS (SELECT a.c AS a, b.c AS b FROM g a JOIN g b USING (g) WHERE a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.5)
SELECT DISTINCT e.rule_id, class_id, (SELECT count(*) FROM p WHERE p.a = k.c) AS links FROM e JOIN k USING (set)
"""

P3_SQL = """
WITH u AS (SELECT DISTINCT ON (content_hash, model_digest, prefix) content_hash AS h, model_digest AS m, prefix AS p, CAST(embedding AS DOUBLE[]) AS v FROM embedding_cache
  WHERE content_hash IS NOT NULL AND model_digest IS NOT NULL AND prefix IS NOT NULL AND len(embedding) = 64
    AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
s AS (SELECT a.m, a.p, a.h AS x, b.h AS y, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.m = b.m AND a.p = b.p AND a.h <> b.h),
r AS (SELECT *, row_number() OVER (PARTITION BY m, p, x ORDER BY c DESC, y) AS rank FROM s WHERE c >= 0.9)
SELECT DISTINCT m AS model_digest, p AS prefix, least(x, y) AS hash_a, greatest(x, y) AS hash_b FROM r WHERE rank <= 5
"""

QUERIES = {f.__name__: f for f in (
    p1_found, p1_classes, p2_found, p2_labels, p3_found, p6_ids, p7_found, p7_spans, p8_found, p8_scores, p8_rates,
)}
SQL = {"p1_found": P1_SQL, "p1_classes": P1_CLASSES_SQL, "p3_found": P3_SQL}
