"""The point-in-time and snapshot problems on their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions.text import CURLY, STRAIGHT, reference, unversioned
from chronotext.operators.asof import attributes_as_known, known_intervals
from chronotext.operators.snapshots import snapshot_changes
from chronotext.plans.registry import WORDS_SQL, number_sql


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passage that held for each candidate's rule on its day, as far as was known that day."""
    ref = reference(F.col("source_ref"))
    intervals = known_intervals(
        spark.read.parquet(f"{sf_dir}/passages.parquet"),
        row_id=F.col("passage_id"), series=ref, entity=unversioned(ref),
        published=F.col("published_at"), valid_from=F.col("valid_from"), valid_to=F.col("valid_to"),
    )
    candidates = spark.read.parquet(f"{sf_dir}/candidates.parquet")
    known = attributes_as_known(candidates, intervals, event_id=F.col("candidate_id"), entity=unversioned(reference(F.col("about"))), at=F.col("as_of"))
    return known.select(F.col("event_id").alias("candidate_id"), F.col("row_id").alias("passage_id"))


P4_SQL = r"""
WITH p AS (
  SELECT passage_id, lower(regexp_replace(source_ref, '^\s+|[\s.]+$', '', 'g')) AS ref, published_at, valid_from, valid_to FROM passages
), c AS (
  SELECT DISTINCT candidate_id, as_of, lower(regexp_replace(about, '^\s+|[\s.]+$', '', 'g')) AS rule FROM candidates WHERE as_of IS NOT NULL
), known AS (
  SELECT c.candidate_id, c.as_of, p.*,
    row_number() OVER (PARTITION BY c.candidate_id, p.ref ORDER BY p.published_at DESC, p.passage_id DESC) AS r
  FROM c JOIN p ON regexp_replace(p.ref, '@[^:]*:', ':') = c.rule AND p.published_at <= c.as_of
)
SELECT candidate_id, arg_max(passage_id, (valid_from, published_at, passage_id)) AS passage_id
FROM known WHERE r = 1 AND valid_from <= as_of AND (valid_to IS NULL OR as_of < valid_to) GROUP BY candidate_id
"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules added, removed, changed, moved or scored anew from one snapshot of a document to the next."""
    c = F.col
    return snapshot_changes(
        spark.read.parquet(f"{sf_dir}/rule_snapshots.parquet"),
        doc=c("doc"), snap=c("snap_no"), delivered=c("delivered_at"), number=c("number"), text=c("text"), score=c("similarity"),
    )


_QUOTES = CURLY, STRAIGHT.replace("'", "''")
_CANONICAL = f"trim(regexp_replace(translate(text, '{_QUOTES[0]}', '{_QUOTES[1]}'), '[\\s\\x0b\\x{{85}}\\pZ]+', ' ', 'g'), ' ')"
_BY_NUMBER = f"{number_sql('number')}, number"

# Pairs are taken best first by rounds of mutual bests; a copy of a text is a row of its own.
P5_SQL = f"""
WITH RECURSIVE r AS (SELECT doc, snap_no AS s, delivered_at AS d, number, {_CANONICAL} AS t, CASE WHEN NOT isnan(similarity) THEN similarity END AS score FROM rule_snapshots WHERE doc IS NOT NULL AND snap_no IS NOT NULL),
snaps AS (SELECT doc, s, max(d) AS latest, lead(s) OVER (PARTITION BY doc ORDER BY s) AS nx, lag(s) OVER (PARTITION BY doc ORDER BY s) AS before FROM r GROUP BY doc, s),
k AS (SELECT r.doc, r.s, nx, before, number, t, md5(t) AS h, max(score) AS score FROM r JOIN snaps USING (doc, s) WHERE d IS NOT DISTINCT FROM latest AND number IS NOT NULL AND t IS NOT NULL GROUP BY ALL),
o AS (SELECT doc, nx AS s, number, t, h, score FROM k WHERE nx IS NOT NULL), n AS (SELECT doc, s, number, t, h, score FROM k WHERE before IS NOT NULL),
o1 AS (SELECT *, row_number() OVER (PARTITION BY doc, s, h ORDER BY {_BY_NUMBER}) AS i FROM o ANTI JOIN n USING (doc, s, number, h)), n1 AS (SELECT *, row_number() OVER (PARTITION BY doc, s, h ORDER BY {_BY_NUMBER}) AS i FROM n ANTI JOIN o USING (doc, s, number, h)),
o2 AS (SELECT *, row_number() OVER (PARTITION BY doc, s, h ORDER BY i) AS j FROM o1 ANTI JOIN n1 USING (doc, s, h, i)), n2 AS (SELECT *, row_number() OVER (PARTITION BY doc, s, h ORDER BY i) AS j FROM n1 ANTI JOIN o1 USING (doc, s, h, i)),
w AS (SELECT h, {WORDS_SQL.replace('(text,', '(t,')} AS w FROM (SELECT h, any_value(t) AS t FROM (SELECT h, t FROM o2 UNION ALL SELECT h, t FROM n2) GROUP BY h)),
g AS (SELECT h, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
og AS (SELECT DISTINCT doc, s, h, len(g) AS size, unnest(g) AS g FROM o2 JOIN g USING (h)), ng AS (SELECT DISTINCT doc, s, h, len(g) AS size, unnest(g) AS g FROM n2 JOIN g USING (h)),
e AS (SELECT a.doc, a.s, a.h AS oh, b.h AS nh, count(*) / (a.size + b.size - count(*)) AS sim FROM og a JOIN ng b ON a.doc = b.doc AND a.s = b.s AND a.g = b.g GROUP BY a.doc, a.s, a.h, b.h, a.size, b.size HAVING count(*) / (a.size + b.size - count(*)) >= 0.5),
c AS (SELECT e.doc, e.s, oh, nh, sim, o2.j AS oj, n2.j AS nj, o2.number AS old_number, n2.number AS new_number, false AS done FROM e JOIN o2 ON o2.doc = e.doc AND o2.s = e.s AND o2.h = oh JOIN n2 ON n2.doc = e.doc AND n2.s = e.s AND n2.h = nh
  UNION ALL
  SELECT doc, s, oh, nh, sim, oj, nj, old_number, new_number, best FROM (SELECT *, bool_or(best) OVER (PARTITION BY doc, s, oh, oj) AS old_used, bool_or(best) OVER (PARTITION BY doc, s, nh, nj) AS new_used FROM (
    SELECT *, row_number() OVER (PARTITION BY doc, s, oh, oj ORDER BY sim DESC, oh, nh, oj, nj) = 1 AND row_number() OVER (PARTITION BY doc, s, nh, nj ORDER BY sim DESC, oh, nh, oj, nj) = 1 AS best FROM c WHERE NOT done))
  WHERE best OR NOT (old_used OR new_used)),
p AS (SELECT * FROM c WHERE done)
SELECT doc, s AS snap_no, number AS old_number, number AS new_number, 'rescored' AS kind FROM o JOIN n USING (doc, s, number, h) WHERE abs(o.score - n.score) > 0.001
UNION ALL SELECT doc, s, o1.number, n1.number, 'moved' FROM o1 JOIN n1 USING (doc, s, h, i)
UNION ALL SELECT doc, s, old_number, new_number, 'changed' FROM p
UNION ALL SELECT doc, s, number, '', 'removed' FROM o2 WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc = o2.doc AND p.s = o2.s AND p.oh = o2.h AND p.oj = o2.j)
UNION ALL SELECT doc, s, '', number, 'added' FROM n2 WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc = n2.doc AND p.s = n2.s AND p.nh = n2.h AND p.nj = n2.j)
"""

QUERIES = {"p4_found": p4_found, "p5_found": p5_found}
SQL = {"p4_found": P4_SQL, "p5_found": P5_SQL}
