"""What the registered queries share: their register, the tables, and the SQL forms of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions.text import reference
from chronotext.operators import stats

c = F.col
AS_OF = "2025-06-01"
MODEL, PREFIX = "sha256:6c1f0a9be2", "search_document: "
OTHER_MODEL, OTHER_PREFIX = "sha256:d27ae45190", ""
REF_SQL = r"lower(regexp_replace(source_ref, '^\s+|[\s.]+$', '', 'g'))"


class Register:
    """Queries under their functions' names, and the SQL that they are checked against."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a passage, with its reference (``ref``), document and version."""
    rows = table(spark, sf_dir, "passages").dropDuplicates(["passage_id"])
    return rows.withColumn("ref", reference(c("source_ref"))).withColumn("doc", F.substring_index("ref", "@", 1)).withColumn("version", F.regexp_extract("ref", "@([0-9.]+):", 1))


P_SQL = f"p AS (SELECT DISTINCT ON (passage_id) *, {REF_SQL} AS ref, split_part({REF_SQL}, '@', 1) AS doc, regexp_extract({REF_SQL}, '@([0-9.]+):', 1) AS version FROM passages)"
WORDS_SQL = "regexp_extract_all(lower(replace(replace(text, '‘', ''''), '’', '''')), '[a-z0-9'']+')"


def wilson_sql(k: str, n: str) -> str:
    z = stats.Z95
    half = f"{z} * sqrt(({k}/{n}) * (1 - {k}/{n}) / {n} + {z * z} / (4.0 * {n} * {n})) / (1 + {z * z} / {n})"
    centre = f"({k}/{n} + {z * z} / (2.0 * {n})) / (1 + {z * z} / {n})"
    return f"round(greatest(0, {centre} - {half}), 6) AS low, round(least(1, {centre} + {half}), 6) AS high"


def number_sql(column: str) -> str:
    """A string that sorts as rule numbers do."""
    return f"array_to_string(list_transform(string_split({column}, '.'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN lpad(x, 10, '0') ELSE x END), '.')"


def _sequences_sql(words: str) -> str:
    three = f"list_distinct(list_transform(range(1, len({words}) - 1), lambda i: {words}[i] || ' ' || {words}[i + 1] || ' ' || {words}[i + 2]))"
    return f"CASE WHEN len({words}) >= 3 THEN {three} WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE [] END"


XREF_SQL = r"(?i)\b(?:rules?|step)\s+\d+(?:\.\w+)*\.?|^\d+\.\s"


def align_sql(old: str, new: str, by: str) -> str:
    """CTEs from ``old`` and ``new`` (``by``, number, text; distinct) to ``matched``: by, old_number, old_text, new_number, new_text, similarity."""
    both = f"o.{by} = n.{by}"
    return f"""
same AS (SELECT o.{by}, o.number, o.text FROM {old} o JOIN {new} n ON {both} AND o.number = n.number AND o.text = n.text),
ok AS (SELECT *, row_number() OVER (PARTITION BY {by}, text ORDER BY {number_sql('number')}, number) AS k FROM {old} o WHERE NOT EXISTS (SELECT 1 FROM same s WHERE s.{by} = o.{by} AND s.number = o.number)),
nk AS (SELECT *, row_number() OVER (PARTITION BY {by}, text ORDER BY {number_sql('number')}, number) AS k FROM {new} n WHERE NOT EXISTS (SELECT 1 FROM same s WHERE s.{by} = n.{by} AND s.number = n.number)),
eq AS (SELECT {by}, number AS old_number, text AS old_text, number AS new_number, text AS new_text FROM same UNION ALL SELECT o.{by}, o.number, o.text, n.number, n.text FROM ok o JOIN nk n ON {both} AND o.text = n.text AND o.k = n.k),
rest AS (SELECT o.* FROM {old} o WHERE NOT EXISTS (SELECT 1 FROM eq e WHERE e.{by} = o.{by} AND e.old_number = o.number)),
ow AS (SELECT {by}, number, text, {_sequences_sql('w')} AS g FROM (SELECT {by}, number, text, {WORDS_SQL} AS w FROM rest)), nw AS (SELECT {by}, number, text, {_sequences_sql('w')} AS g FROM (SELECT {by}, number, text, {WORDS_SQL} AS w FROM {new})),
oe AS (SELECT {by}, number, text, len(g) AS size, unnest(g) AS g FROM ow), ne AS (SELECT {by}, number, text, len(g) AS size, unnest(g) AS g FROM nw),
sims AS (SELECT o.{by}, o.number AS old_number, o.text AS old_text, n.number AS new_number, n.text AS new_text, count(*) / (any_value(o.size) + any_value(n.size) - count(*)) AS sim FROM oe o JOIN ne n ON {both} AND o.g = n.g GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY {by}, old_number ORDER BY sim DESC, {number_sql('new_number')}, new_number) AS place FROM sims WHERE sim >= 0.5),
hits AS (SELECT {by}, old_number, old_text, new_number, new_text, 1.0::DOUBLE AS similarity FROM eq UNION ALL
  SELECT r.{by}, r.number, r.text, b.new_number, b.new_text, coalesce(b.sim, 0) FROM rest r LEFT JOIN (SELECT * FROM best WHERE place = 1) b ON b.{by} = r.{by} AND b.old_number = r.number),
matched AS (SELECT * FROM hits UNION ALL SELECT n.{by}, NULL, NULL, n.number, n.text, 0 FROM {new} n WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.{by} = n.{by} AND h.new_number = n.number))"""


def changes_sql(flip_words: list[str], by: str) -> str:
    """CTE ``changes``: ``matched`` with status and flips."""
    blank = lambda c: f"regexp_replace({c}, '{XREF_SQL}', 'rule #', 'g')"
    word = lambda c: f"list_distinct({WORDS_SQL.replace('(text,', '(' + blank(c) + ',')})"
    flips = ", ".join("'" + w.replace("'", "''") + "'" for w in flip_words)
    turns = f"lambda w: list_contains([{flips}], w) OR regexp_full_match(w, '[0-9]+')"
    less = lambda a, b: f"list_filter({word(a)}, lambda w: NOT list_contains({word(b)}, w))"
    status = f"CASE WHEN new_text IS NULL THEN 'removed' WHEN old_text IS NULL THEN 'added' WHEN {blank('old_text')} <> {blank('new_text')} THEN 'changed' WHEN old_number <> new_number THEN 'renumbered' ELSE 'unchanged' END"
    return f"changes AS (SELECT *, CASE WHEN status = 'changed' THEN len(list_filter(list_concat({less('old_text', 'new_text')}, {less('new_text', 'old_text')}), {turns})) END AS flips FROM (SELECT *, {status} AS status FROM matched))"
