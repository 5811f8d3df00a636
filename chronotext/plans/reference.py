"""The library's own operators on the test tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronotext.functions.text import reference
from chronotext.operators import align, answers, evaluate, lineage, stats, temporal
from chronotext.plans.core import P4_SQL, p4_found
from chronotext.plans.registry import AS_OF, MODEL, P_SQL, PREFIX, REF_SQL, XREF_SQL, Register, align_sql, c, changes_sql, number_sql, passages, table, wilson_sql
from chronotext.session import materialize
from chronotext.sources import parse
from chronotext.streaming import updates

query = Register()
QUERIES, SQL = query.queries, query.sql

# --- time -----------------------------------------------------------------------------------------------------------------


@query(f"WITH {P_SQL} SELECT passage_id, published_at, lead(published_at) OVER w AS valid_until, coalesce(lead(true) OVER w, false) AS newer_exists FROM p WINDOW w AS (PARTITION BY ref ORDER BY published_at, passage_id)")
def version_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each passage was restated, and whether it was."""
    return temporal.windows_by_successor(passages(spark, sf_dir), ["ref"], "published_at", "passage_id").select("passage_id", "published_at", "valid_until", "newer_exists")


@query(f"WITH {P_SQL} SELECT passage_id, valid_from, valid_to FROM p WHERE valid_from <= DATE '{AS_OF}' AND (valid_to IS NULL OR DATE '{AS_OF}' < valid_to)")
def asof_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages in force on a day."""
    return passages(spark, sf_dir).where(temporal.in_force(F.lit(AS_OF).cast("date"), c("valid_from"), c("valid_to"))).select("passage_id", "valid_from", "valid_to")


@query(f"""
WITH {P_SQL}, v AS (SELECT doc, version, min(valid_from) AS e, min(published_at) AS d FROM p GROUP BY ALL),
w AS (SELECT *, lead(e) OVER o AS nx, lead(1) OVER o IS NULL AS last FROM v
      WINDOW o AS (PARTITION BY doc ORDER BY list_transform(string_split(version, '.'), lambda x: try_cast(x AS INT)), version)),
r AS (SELECT *, CASE WHEN e IS NULL THEN 'effective date unknown' WHEN e < d THEN 'effective before printed date' WHEN last THEN NULL
      WHEN nx IS NULL THEN 'successor date unknown' WHEN nx <= e THEN 'successor not after this version' END AS refused FROM w)
SELECT doc, version, CASE WHEN refused IS NULL THEN e END AS valid_from, CASE WHEN refused IS NULL THEN nx END AS valid_to, refused FROM r""")
def refused_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document version's window, or why it has none."""
    versions = passages(spark, sf_dir).groupBy("doc", "version").agg(F.min("valid_from").alias("effective"), F.min("published_at").alias("printed"))
    return temporal.validity_windows(versions, ["doc"], "version", "effective", "printed")


@query(f"""
WITH {P_SQL}, k AS (SELECT doc, max(list_transform(string_split(version, '.'), lambda x: try_cast(x AS INT))) AS newest FROM p GROUP BY doc),
r AS (SELECT DISTINCT split_part(document_id, '@', 1) AS doc, split_part(document_id, '@', 2) AS version FROM rules)
SELECT r.doc, r.version FROM r LEFT JOIN k USING (doc) WHERE newest IS NULL OR list_transform(string_split(r.version, '.'), lambda x: try_cast(x AS INT)) > newest""")
def pending_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions of the rules newer than any of their document's passages."""
    registered = table(spark, sf_dir, "rules").select(F.substring_index("document_id", "@", 1).alias("doc"), F.substring_index("document_id", "@", -1).alias("version"))
    return temporal.pending(registered, passages(spark, sf_dir), ["doc"], "version")


@query(f"""
WITH found AS ({P4_SQL}), {P_SQL}, k AS (SELECT DISTINCT ON (candidate_id) candidate_id, current_refs, stale_refs FROM candidates)
SELECT candidate_id, CASE WHEN list_contains(stale_refs, ref) THEN 'captured' WHEN list_contains(current_refs, ref) THEN 'not captured' ELSE 'inconclusive' END AS verdict
FROM found JOIN k USING (candidate_id) JOIN p USING (passage_id)""")
def drift_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what was known on a candidate's day is what its author later called stale."""
    noted = table(spark, sf_dir, "candidates").dropDuplicates(["candidate_id"]).select("candidate_id", "current_refs", "stale_refs")
    rows = p4_found(spark, sf_dir).join(noted, "candidate_id").join(passages(spark, sf_dir).select("passage_id", "ref"), "passage_id")
    verdict = F.when(F.array_contains("stale_refs", c("ref")), "captured").when(F.array_contains("current_refs", c("ref")), "not captured").otherwise("inconclusive")
    return rows.select("candidate_id", verdict.alias("verdict"))


# --- statistics --------------------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(value) AS n, round(median(value), 6) AS median, list_sort(list(value))[(count(value) - 1) * 9 // 10 + 1] AS p90, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, the reference's 90% value and the maximum of each kind of event."""
    return evaluate.latency_summary(table(spark, sf_dir, "events"), ["event_type"], "value").withColumn("median", F.round("median", 6))


_RATES = "WITH g AS (SELECT DISTINCT ON (gen_id) * FROM generations), r AS (SELECT coalesce(done_reason, 'none') AS done, answer_tokens * 1e9 / answer_ns AS rate FROM g WHERE answer_ns > 0 AND answer_tokens IS NOT NULL)"


@query(f"{_RATES} SELECT done, count(*) AS n, round(median(rate), 6) AS median, round(list_sort(list(rate))[(count(*) - 1) * 9 // 10 + 1], 6) AS p90, round(max(rate), 6) AS max FROM r GROUP BY done")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens a second by how the generation ended."""
    rows = table(spark, sf_dir, "generations").dropDuplicates(["gen_id"]).where("answer_ns > 0 AND answer_tokens IS NOT NULL")
    rows = rows.select(F.coalesce("done_reason", F.lit("none")).alias("done"), (c("answer_tokens") * F.lit(1e9) / c("answer_ns")).alias("rate"))
    found = evaluate.latency_summary(rows, ["done"], "rate")
    return found.select("done", "n", *[F.round(x, 6).alias(x) for x in ("median", "p90", "max")])


@query(f"WITH s AS (SELECT rater, count(toxic)::DOUBLE AS n, count(*) FILTER (WHERE toxic = 1)::DOUBLE AS k FROM doc_labels GROUP BY rater HAVING count(toxic) > 0) SELECT rater, n::BIGINT AS n, k::BIGINT AS k, {wilson_sql('k', 'n')} FROM s")
def wilson_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rater's share of bad marks with its 95% interval."""
    rows = table(spark, sf_dir, "doc_labels").groupBy("rater").agg(F.count("toxic").alias("n"), F.count(F.when(c("toxic") == 1, 1)).alias("k")).where("n > 0")
    rows = rows.withColumn("w", stats.wilson(c("k"), c("n")))
    return rows.select("rater", "n", "k", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@query(f"""WITH s AS (SELECT category, count(DISTINCT ruling_id)::DOUBLE AS n FROM rulings GROUP BY category), h AS (SELECT category, n, {wilson_sql('round(0.5 * n)', 'n').replace('round(greatest', '(greatest').replace(', 6) AS low', ') AS low').replace('round(least', '(least').replace(', 6) AS high', ') AS high')} FROM s)
SELECT category, n::BIGINT AS n, round((high - low) / 2, 6) AS half_width FROM h""")
def half_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How exactly a share of one half could be measured on the rulings of each category."""
    rows = table(spark, sf_dir, "rulings").groupBy("category").agg(F.countDistinct("ruling_id").alias("n"))
    return rows.select("category", "n", F.round(stats.half_width(F.lit(0.5), c("n")), 6).alias("half_width"))


@query("""
WITH g AS (SELECT DISTINCT ON (gen_id) * FROM generations), r AS (SELECT median(prompt_tokens * 1e9 / prompt_ns) FILTER (WHERE prompt_ns > 0) AS prefill, median(answer_tokens * 1e9 / answer_ns) FILTER (WHERE answer_ns > 0) AS decode FROM g),
t AS (SELECT count(DISTINCT ruling_id) AS questions FROM rulings) SELECT questions, round(3000 / prefill + 180 / decode, 6) AS answer_s, round(questions * (3000 / prefill + 180 / decode) / 3600, 6) AS hours FROM r, t""")
def answer_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds an answer of the assumed length takes at the measured median rates, and hours for every ruling."""
    rows = table(spark, sf_dir, "generations").dropDuplicates(["gen_id"])
    rate = lambda tokens, ns: rows.where(f"{ns} > 0").select((c(tokens) * F.lit(1e9) / c(ns)).alias("rate"))
    prefill, decode = (evaluate.latency_summary(rate(f"{x}_tokens", f"{x}_ns"), [], "rate").select(c("median").alias(x)) for x in ("prompt", "answer"))
    asked = table(spark, sf_dir, "rulings").agg(F.countDistinct("ruling_id").alias("questions"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    both = one(asked).join(one(prefill), "_one").join(one(decode), "_one")
    seconds = 3000 / c("prompt") + 180 / c("answer")
    return both.select("questions", F.round(seconds, 6).alias("answer_s"), F.round(c("questions") * seconds / 3600, 6).alias("hours"))


@query(f"""WITH m AS (SELECT doc_id, rater, max(toxic) AS mark FROM doc_labels GROUP BY ALL), p AS (SELECT x.mark AS x, y.mark AS y FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.rater < y.rater),
s AS (SELECT count(*) FILTER (WHERE x = y)::DOUBLE AS k, count(*) FILTER (WHERE x <> y) AS disagree, count(*) FILTER (WHERE x IS NULL OR y IS NULL) AS unsure, count(*)::DOUBLE AS n FROM p)
SELECT k::BIGINT AS agree, disagree, unsure, n::BIGINT AS n, {wilson_sql('k', 'n')} FROM s""")
def review_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two raters of a document agree, disagree or leave it open."""
    rows = _rater_pairs(spark, sf_dir).agg(F.count(F.when(c("x") == c("y"), 1)).alias("agree"), F.count(F.when(c("x") != c("y"), 1)).alias("disagree"), F.count(F.when(c("x").isNull() | c("y").isNull(), 1)).alias("unsure"), F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("w", stats.wilson(c("agree"), c("n")))
    return rows.select("agree", "disagree", "unsure", "n", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


def _rater_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of one document by two raters."""
    marks = table(spark, sf_dir, "doc_labels").groupBy("doc_id", "rater").agg(F.max("toxic").alias("mark"))
    return marks.select("doc_id", c("rater").alias("a"), c("mark").alias("x")).join(marks.select("doc_id", c("rater").alias("b"), c("mark").alias("y")), "doc_id").where("a < b")


@query("""
WITH m AS (SELECT doc_id, rater, max(toxic) AS mark FROM doc_labels GROUP BY ALL), p AS (SELECT x.rater AS a, y.rater AS b, x.mark AS x, y.mark AS y FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.rater < y.rater WHERE x.mark IS NOT NULL AND y.mark IS NOT NULL),
s AS (SELECT a, b, count(*) AS n, count(*) FILTER (WHERE x = y) AS agree, (sum(x) * sum(y) + (count(*) - sum(x)) * (count(*) - sum(y))) / (count(*) * count(*)) AS pe FROM p GROUP BY a, b)
SELECT a, b, n, agree, CASE WHEN pe < 1 THEN round((agree / n - pe) / (1 - pe), 6) END AS kappa FROM s""")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohen's kappa of every two raters."""
    return stats.kappa(_rater_pairs(spark, sf_dir), ["a", "b"], "x", "y").withColumn("kappa", F.round("kappa", 6))


@query()
def bootstrap_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of kappa over all pairs of raters."""
    return stats.bootstrap_kappa(_rater_pairs(spark, sf_dir), "x", "y")


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A simple forecast that a generation ends by itself: longer ones don't."""
    rows = table(spark, sf_dir, "generations").dropDuplicates(["gen_id"]).where("answer_tokens IS NOT NULL AND done_reason IS NOT NULL")
    return rows.select("gen_id", (1 / (1 + c("answer_tokens") / F.lit(400.0))).alias("p"), (c("done_reason") == "stop").cast("int").alias("y"))


_PRED = "WITH g AS (SELECT DISTINCT ON (gen_id) * FROM generations), f AS (SELECT gen_id, 1 / (1 + answer_tokens / 400.0::DOUBLE) AS p, CASE WHEN done_reason = 'stop' THEN 1.0::DOUBLE ELSE 0 END AS y FROM g WHERE answer_tokens IS NOT NULL AND done_reason IS NOT NULL), b AS (SELECT *, ntile(5) OVER (ORDER BY p, gen_id) AS bin FROM f)"


@query(f"{_PRED} SELECT bin::INT AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM b GROUP BY bin")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast and outcome in equal-count bins."""
    rows = stats.calibration_bins(_predictions(spark, sf_dir), "gen_id", "p", "y")
    return rows.select("bin", "n", F.round("predicted", 6).alias("predicted"), F.round("observed", 6).alias("observed"))


@query(f"{_PRED}, t AS (SELECT count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM b GROUP BY bin), m AS (SELECT avg((p - y) ** 2) AS brier, avg(y) * (1 - avg(y)) AS base FROM f) SELECT round(sum(n * gap) / sum(n), 6) AS ece, round(any_value(brier), 6) AS brier, round(any_value(base), 6) AS base, round(1 - any_value(brier) / any_value(base), 6) AS skill FROM t, m")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected calibration error, Brier score, its base and the skill over it."""
    rows = stats.calibration(_predictions(spark, sf_dir), "gen_id", "p", "y")
    return rows.select(*[F.round(x, 6).alias(x) for x in ("ece", "brier", "base", "skill")])


@query()
def logistic_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold chance that a generation ended by itself, from signals of its answer."""
    rows = table(spark, sf_dir, "generations").dropDuplicates(["gen_id"]).where("text IS NOT NULL AND done_reason IS NOT NULL AND answer_tokens IS NOT NULL")
    cited = F.size(answers.citations(c("text")))
    rows = rows.select(
        "gen_id", (c("done_reason") == "stop").cast("int").alias("y"), F.log1p("answer_tokens").alias("tokens"), cited.cast("double").alias("cited"),
        answers.abstains(c("text")).cast("double").alias("abstains"), c("text").rlike(r"[.!?)\]]\s*$").cast("double").alias("closed"),
    )
    return stats.out_of_fold(rows, "gen_id", ["tokens", "cited", "abstains", "closed"], "y").select("gen_id", "y", F.round("probability", 6).alias("probability"))


# --- answers ------------------------------------------------------------------------------------------------------------------


@query(r"""
WITH g AS (SELECT DISTINCT ON (gen_id) * FROM generations WHERE text IS NOT NULL), x AS (SELECT *, list_sort(list_distinct(regexp_extract_all(text, 'core@\d+\.\d+:\d{3}(?:\.[0-9a-z]+)*'))) AS cites FROM g)
SELECT gen_id, array_to_string(cites, ' ') AS cited, len(cites) AS n, regexp_matches(text, '(?i)\b(?:do(?:es)? not|don''t|doesn''t) (?:answer|contain|cover|address|specify|say|mention)|not (?:enough|sufficient) information|cannot be determined|no information') AS abstains,
  round(ln(1 + answer_tokens), 6) AS log_tokens FROM x""")
def answer_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations, abstention and length of every answer."""
    rows = table(spark, sf_dir, "generations").dropDuplicates(["gen_id"]).where("text IS NOT NULL").withColumn("cites", answers.citations(c("text")))
    return rows.select("gen_id", F.array_join("cites", " ").alias("cited"), F.size("cites").cast("bigint").alias("n"), answers.abstains(c("text")).alias("abstains"), F.round(F.log1p("answer_tokens"), 6).alias("log_tokens"))


@query("WITH r AS (SELECT DISTINCT ON (ruling_id) * FROM rulings WHERE answer IS NOT NULL), s AS (SELECT ruling_id, regexp_replace(lower(trim(split_part(answer, chr(10), 1), ' ')), '[.]+$', '') AS f FROM r) SELECT ruling_id, CASE WHEN f IN ('yes', 'no') THEN f ELSE 'other' END AS short FROM s")
def ruling_short_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes, no or other, from the first line of every ruling."""
    rows = table(spark, sf_dir, "rulings").dropDuplicates(["ruling_id"]).where("answer IS NOT NULL")
    return rows.select("ruling_id", answers.short_answer(c("answer")).alias("short"))


@query(r"SELECT DISTINCT doc_id, sha256(regexp_replace(text, '<\s*/?\s*retrieved_passages\s*>', '[delimiter removed]', 'gi')) AS escaped FROM documents WHERE text IS NOT NULL")
def escape_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made safe to stand inside a prompt."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(answers.escaped(c("text")), 256).alias("escaped")).distinct()


@query(f"""
WITH found AS ({P4_SQL}), {P_SQL}, k AS (SELECT DISTINCT ON (candidate_id) candidate_id, question FROM candidates)
SELECT candidate_id, sha256('<retrieved_passages>' || chr(10) || '[' || ref || ']' || chr(10) || text || chr(10) || '</retrieved_passages>' || chr(10) || chr(10) || 'Question: ' || question) AS prompt_sha256
FROM found JOIN k USING (candidate_id) JOIN p USING (passage_id)""")
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each candidate over the passage that was known on its day, as a digest."""
    asked = table(spark, sf_dir, "candidates").dropDuplicates(["candidate_id"]).select("candidate_id", "question")
    rows = p4_found(spark, sf_dir).join(asked, "candidate_id").join(passages(spark, sf_dir).select("passage_id", "ref", "text"), "passage_id")
    return rows.select("candidate_id", F.sha2(answers.prompt(c("question"), F.array(F.struct(c("ref").alias("source_ref"), "text"))), 256).alias("prompt_sha256"))


@query()
def quote_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without what they copy from the passages that they cite."""
    rows = table(spark, sf_dir, "generations").dropDuplicates(["gen_id"]).where("text IS NOT NULL").select("gen_id", "text", F.explode_outer(answers.citations(c("text"))).alias("ref"))
    # All texts of a reference: an answer may copy what was said before it was restated.
    texts = passages(spark, sf_dir).where("text IS NOT NULL").select("ref", c("text").alias("passage")).distinct()
    held = rows.join(texts, "ref", "left").groupBy("gen_id", "text").agg(F.array_sort(F.collect_list(F.when(c("passage").isNotNull(), F.struct("ref", "passage")))).alias("p"))
    clean = held.withColumn("r", answers.redact(c("text"), F.transform("p", lambda x: x["ref"]), F.transform("p", lambda x: x["passage"])))
    return clean.select("gen_id", c("r.quotes").alias("quotes"), c("r.answer").alias("answer"))


# --- editions ------------------------------------------------------------------------------------------------------------------


def _editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document_id`` and the ``next_id`` of its document."""
    ids = table(spark, sf_dir, "rules").select("document_id").distinct()
    order = Window.partitionBy(F.substring_index("document_id", "@", 1)).orderBy(temporal.version_key(F.substring_index("document_id", "@", -1)), "document_id")
    return ids.withColumn("next_id", F.lead("document_id").over(order)).where("next_id IS NOT NULL")


def _edition_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rules of each edition as ``new``, and of the edition before it as ``old``; by ``document_id`` of the new one."""
    rules = table(spark, sf_dir, "rules").where("number IS NOT NULL AND text IS NOT NULL").dropDuplicates(["document_id", "number"]).select("document_id", "number", "text")
    following = _editions(spark, sf_dir)
    old = rules.join(following, "document_id").select(c("next_id").alias("document_id"), "number", "text")
    return old, rules.join(following.select(c("next_id").alias("document_id")), "document_id", "left_semi")


_RULES = "rl AS (SELECT DISTINCT ON (document_id, number) document_id, number, text FROM rules WHERE number IS NOT NULL AND text IS NOT NULL)"
_VERSION = "list_transform(string_split(split_part(document_id, '@', -1), '.'), lambda x: try_cast(x AS INT))"
_EDITIONS = f"ed AS (SELECT document_id, lead(document_id) OVER (PARTITION BY split_part(document_id, '@', 1) ORDER BY {_VERSION}, document_id) AS next_id FROM (SELECT DISTINCT document_id FROM rules))"
_CHANGES = f"""WITH {_RULES}, {_EDITIONS}, o_r AS (SELECT next_id AS document_id, number, text FROM rl JOIN ed USING (document_id) WHERE next_id IS NOT NULL),
n_r AS (SELECT * FROM rl WHERE document_id IN (SELECT next_id FROM ed WHERE next_id IS NOT NULL)), {align_sql('o_r', 'n_r', 'document_id')}, {changes_sql(align.FLIP_WORDS, 'document_id')}"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.what_changed(align.align(*_edition_pairs(spark, sf_dir), ["document_id"]), ["document_id"])


@query(f"{_CHANGES} SELECT document_id, old_number, new_number, round(similarity, 6) AS similarity, status, flips FROM changes")
def align_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of consecutive editions with its match, how it changed, and how the meaning may have."""
    return _changes(spark, sf_dir).select("document_id", "old_number", "new_number", F.round("similarity", 6).alias("similarity"), "status", "flips")


@query(f"{_CHANGES} SELECT document_id, status, count(*) AS n FROM changes GROUP BY ALL")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rules of each edition are changed, added, removed, renumbered and unchanged."""
    return _changes(spark, sf_dir).groupBy("document_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query()
def changed_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed rules as word diffs."""
    rows = _changes(spark, sf_dir).where("status = 'changed'")
    return rows.select("document_id", "old_number", "new_number", "flips", align.word_diff(c("old_text"), c("new_text")).alias("diff"))


@query(f"{_CHANGES} SELECT document_id, new_number AS number, old_number, regexp_replace(old_text, '{XREF_SQL}', 'rule #', 'g') = regexp_replace(new_text, '{XREF_SQL}', 'rule #', 'g') AS same_text FROM changes WHERE old_text IS NOT NULL AND new_text IS NOT NULL")
def counterparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule's counterpart in the edition before, and whether it says the same."""
    return align.counterparts(_changes(spark, sf_dir), ["document_id"])


@query(f"{_CHANGES} SELECT * FROM (SELECT document_id, old_number, new_number, flips, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY document_id ORDER BY flips DESC, similarity, {number_sql('old_number')}, old_number) AS rank FROM changes WHERE status = 'changed') WHERE rank <= 20")
def top_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty changes of each edition that most likely turn a meaning (a top-k report)."""
    rows = align.top_changes(_changes(spark, sf_dir), ["document_id"], 20)
    return rows.select("document_id", "old_number", "new_number", "flips", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""{_CHANGES}, a AS (SELECT DISTINCT candidate_id, split_part(ref, ':', 1) AS doc, split_part(ref, ':', -1) AS number FROM (SELECT candidate_id, {REF_SQL.replace('source_ref', 'about')} AS ref FROM candidates WHERE about IS NOT NULL)),
st AS (SELECT document_id, old_number AS number, min(status) AS status FROM changes WHERE old_number IS NOT NULL GROUP BY ALL)
SELECT e.next_id AS document_id, candidate_id, a.number, coalesce(status, 'missing') AS status FROM a JOIN ed e ON split_part(e.document_id, '@', 1) = doc AND next_id IS NOT NULL LEFT JOIN st ON st.document_id = next_id AND st.number = a.number""")
def rule_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the next edition did to the rules under the numbers that candidates ask about."""
    asked = table(spark, sf_dir, "candidates").where("about IS NOT NULL").select("candidate_id", reference(c("about")).alias("ref"))
    asked = asked.select("candidate_id", F.substring_index("ref", ":", 1).alias("doc"), F.substring_index("ref", ":", -1).alias("number")).distinct()
    steps = _editions(spark, sf_dir).select(F.substring_index("document_id", "@", 1).alias("doc"), c("next_id").alias("document_id"))
    return align.impact(asked.join(steps, "doc").drop("doc"), _changes(spark, sf_dir), ["document_id"], "candidate_id")


@query("WITH d AS (SELECT sha256(text) AS h, count(DISTINCT doc_id) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT * FROM d WHERE n > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that several documents share, as digest, count and lowest id."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("h"))
    return rows.agg(F.countDistinct("doc_id").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


# --- parsing --------------------------------------------------------------------------------------------------------------------


_COUNT = lambda line: f"len(regexp_split_to_array(trim({line}, ' '), '\\s+'))"


def _chunks_sql(cap: int) -> str:
    """CTEs to ``ch``: document_id, source_ref, part, refs, tokens, text of the rules in chunks of at most ``cap`` words."""
    return f"""RECURSIVE rl AS (SELECT DISTINCT ON (document_id, number) document_id, number, text, split_part(number, '.', 1) AS topmost, array_to_string(string_split(number, '.')[1:2], '.') AS source_ref FROM rules WHERE number IS NOT NULL AND text IS NOT NULL),
pa AS (SELECT DISTINCT document_id, topmost FROM rl WHERE number <> topmost), hd AS (SELECT document_id, topmost, number AS hn, number || '. ' || text AS ht FROM rl JOIN pa USING (document_id, topmost) WHERE number = topmost),
mb AS (SELECT rl.document_id, source_ref, number, number || '. ' || text AS line, CASE WHEN contains(source_ref, '.') THEN hn END AS hn, CASE WHEN contains(source_ref, '.') THEN ht END AS ht,
  row_number() OVER (PARTITION BY rl.document_id, source_ref ORDER BY {number_sql('number')}, number) AS i FROM rl LEFT JOIN pa USING (document_id, topmost) LEFT JOIN hd USING (document_id, topmost) WHERE pa.topmost IS NULL OR number <> topmost),
mw AS (SELECT *, {_COUNT('line')} AS w, coalesce({_COUNT('ht')}, 0) AS base FROM mb),
fo AS (SELECT document_id, source_ref, i, 0 AS part, base + w AS used FROM mw WHERE i = 1 UNION ALL
  SELECT m.document_id, m.source_ref, m.i, CASE WHEN f.used + m.w > {cap} THEN f.part + 1 ELSE f.part END, CASE WHEN f.used + m.w > {cap} THEN m.base + m.w ELSE f.used + m.w END
  FROM fo f JOIN mw m ON m.document_id = f.document_id AND m.source_ref = f.source_ref AND m.i = f.i + 1),
ct AS (SELECT document_id, source_ref, part, any_value(hn) AS hn, any_value(ht) AS ht, list(number ORDER BY i) AS ns, string_agg(line, chr(10) ORDER BY i) AS body FROM fo JOIN mw USING (document_id, source_ref, i) GROUP BY ALL),
cx AS (SELECT document_id, source_ref, part, CASE WHEN hn IS NULL THEN ns ELSE list_prepend(hn, ns) END AS refs, CASE WHEN ht IS NULL THEN body ELSE ht || chr(10) || body END AS text FROM ct),
ch AS (SELECT *, {_COUNT('text')}::INT AS tokens FROM cx)"""


@query(f"""WITH {_chunks_sql(parse.CHUNK_TOKENS)}, pg AS (SELECT document_id || '/' || source_ref || '/' || part AS page, hn, ht, ns, list(text ORDER BY i) AS ts FROM ct JOIN fo USING (document_id, source_ref, part) JOIN (SELECT document_id, source_ref, i, line AS text FROM mb) USING (document_id, source_ref, i) GROUP BY ALL),
al AS (SELECT page, unnest(CASE WHEN hn IS NULL THEN ns ELSE list_prepend(hn, ns) END) AS number, unnest(CASE WHEN ht IS NULL THEN ts ELSE list_prepend(ht, ts) END) AS line, unnest(range(0, len(ns) + CASE WHEN hn IS NULL THEN 0 ELSE 1 END))::INT AS place FROM pg)
SELECT page, place, number, trim(regexp_replace(line[len(number) + 2:], '[\\s\\x0b\\x{{85}}\\pZ]+', ' ', 'g'), ' ') AS text FROM al""")
def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of the rules, rendered as text, parsed into numbered rows again."""
    pages = parse.chunks(table(spark, sf_dir, "rules"), "document_id").withColumn("page", F.concat_ws("/", "document_id", "source_ref", "part"))
    return parse.parse_rules(pages, "page", "text")


@query(f"WITH {_chunks_sql(60)} SELECT document_id, source_ref, part, array_to_string(refs, ' ') AS refs, tokens, sha256(text) AS text_sha256 FROM ch")
def chunk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of every edition in chunks of at most 60 words."""
    return parse.chunks(table(spark, sf_dir, "rules"), "document_id", 60).select("document_id", "source_ref", "part", F.array_join("refs", " ").alias("refs"), "tokens", F.sha2("text", 256).alias("text_sha256"))


@query(r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL), a AS (SELECT doc_id, regexp_replace(text, '<[^>]+>', ' ', 'g') AS t FROM d),
b AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM a)
SELECT doc_id, sha256(trim(regexp_replace(replace(replace(t, '\n', ' '), '\"', '"'), '[\t\n\v\f\r \x{85}\pZ]+', ' ', 'g'), ' ')) AS page FROM b""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without markup, as digests."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(parse.page_text(c("text")), 256).alias("page")).distinct()


@query("""
WITH r AS (SELECT DISTINCT ON (ruling_id) ruling_id, created, faq_backed, day(created) % 6 AS k FROM rulings WHERE created IS NOT NULL AND faq_backed IS NOT NULL)
SELECT ruling_id, CASE WHEN NOT faq_backed THEN CASE WHEN k < 5 THEN created END WHEN k < 5 THEN created + 14 END AS date,
  CASE WHEN NOT faq_backed THEN CASE WHEN k < 5 THEN 'announcement-date' ELSE 'no date' END WHEN k < 5 THEN 'stated' ELSE 'ambiguous' END AS basis FROM r""")
def effective_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings as announcement pages, and the day from which each says that it holds: stated in four formats, once or twice, ambiguously or not at all."""
    rows = table(spark, sf_dir, "rulings").dropDuplicates(["ruling_id"]).where("created IS NOT NULL AND faq_backed IS NOT NULL").withColumn("k", F.day("created") % 6)
    at, later = F.date_add("created", 14), F.date_add("created", 15)
    on = lambda phrase, day, form: F.concat(F.lit(f"<p>This ruling {phrase} "), F.date_format(day, form), F.lit(".</p>"))
    said = (
        F.when(c("k") == 0, on("takes effect on", at, "MMMM d, yyyy")).when(c("k") == 1, on("is effective", at, "d MMMM yyyy")).when(c("k") == 2, on("goes into effect", at, "yyyy-MM-dd"))
        .when(c("k") == 3, on("is in effect from", at, "M/d/yyyy")).when(c("k") == 4, F.concat(on("takes effect on", at, "MMMM d, yyyy"), on("is effective", at, "yyyy-MM-dd")))
        .otherwise(F.concat(on("takes effect on", at, "MMMM d, yyyy"), on("is effective", later, "yyyy-MM-dd")))
    )
    printed = F.when(c("faq_backed") | (c("k") < 5), F.concat(F.lit('<script>{"datePublished":"'), c("created").cast("string"), F.lit('T09:00Z"}</script>'))).otherwise("")
    page = F.concat(printed, F.when(c("faq_backed"), said).otherwise(""), F.lit("<p>"), F.coalesce("question", F.lit("")), F.lit("</p>Related Articles <p>Effective 2020-01-01</p>"))
    return rows.withColumn("e", parse.effective(page)).select("ruling_id", "e.date", "e.basis")


@query(f"""
WITH s AS (SELECT passage_id, {REF_SQL} AS ref FROM (SELECT DISTINCT ON (passage_id) * FROM passages))
SELECT passage_id, nullif(regexp_extract(ref, '^([a-z]+)@v?(\\d+\\.\\d+):(\\d{{3}}(?:\\.\\w+)*)$', 1), '') AS doc, nullif(regexp_extract(ref, '^([a-z]+)@v?(\\d+\\.\\d+):(\\d{{3}}(?:\\.\\w+)*)$', 2), '') AS version,
  nullif(regexp_extract(ref, '^([a-z]+)@v?(\\d+\\.\\d+):(\\d{{3}}(?:\\.\\w+)*)$', 3), '') AS number FROM s""")
def parsed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document, version and number of every passage's reference."""
    rows = table(spark, sf_dir, "passages").dropDuplicates(["passage_id"]).withColumn("r", parse.parsed_reference(reference(c("source_ref"))))
    return rows.select("passage_id", "r.doc", "r.version", "r.number")


@query(f"""WITH {_chunks_sql(parse.CHUNK_TOKENS)}, n AS (SELECT document_id, count(DISTINCT number) AS rules FROM rl GROUP BY 1)
SELECT document_id, rules, count(*) AS chunks, round(median(tokens), 6) AS median, max(tokens) AS longest, sum(tokens)::BIGINT AS tokens FROM ch JOIN n USING (document_id) GROUP BY document_id, rules""")
def corpus_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and chunks of every edition, and the words of the chunks."""
    rules = table(spark, sf_dir, "rules")
    made = materialize(parse.chunks(rules, "document_id").select("document_id", "tokens"))
    counts = rules.where("number IS NOT NULL AND text IS NOT NULL").groupBy("document_id").agg(F.countDistinct("number").alias("rules"))
    sizes = evaluate.latency_summary(made, ["document_id"], "tokens").select("document_id", c("n").alias("chunks"), F.round("median", 6).alias("median"), c("max").alias("longest"))
    return counts.join(sizes, "document_id").join(made.groupBy("document_id").agg(F.sum("tokens").alias("tokens")), "document_id")


@query("SELECT DISTINCT about AS entry, 'not doc@MAJOR.MINOR' AS fault FROM (SELECT split_part(source_ref, ':', 1) AS about FROM passages) WHERE about IS NULL OR NOT regexp_full_match(about, '[a-z]+@\\d+\\.\\d+')")
def registry_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions whose id is malformed, as the passages spell them."""
    entries = table(spark, sf_dir, "passages").select(F.substring_index("source_ref", ":", 1).alias("entry")).distinct()
    return parse.registry_faults(entries, "entry")


@query(r"""
WITH s AS (SELECT about AS ref FROM (SELECT DISTINCT candidate_id, about FROM candidates) UNION ALL SELECT source_ref FROM (SELECT DISTINCT passage_id, source_ref FROM passages))
SELECT coalesce(CASE WHEN ref IS NULL OR trim(ref, ' ') = '' THEN 'empty' WHEN NOT contains(ref, '@') THEN 'no version' WHEN NOT contains(ref, ':') THEN 'no rule number'
  WHEN NOT regexp_matches(ref, '^([a-z]+)@v?(\d+\.\d+):(\d{3}(?:\.\w+)*)$') THEN 'malformed' END, 'none') AS error, count(*) AS n FROM s GROUP BY 1""".replace("\\\\", "\\"))
def reference_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the references as they are written, counted."""
    asked = table(spark, sf_dir, "candidates").select("candidate_id", c("about").alias("ref")).distinct().select("ref")
    held = table(spark, sf_dir, "passages").select("passage_id", c("source_ref").alias("ref")).distinct().select("ref")
    rows = asked.unionByName(held).select(parse.parsed_reference(c("ref"))["error"].alias("error"))
    return rows.groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n"))


# --- lineage ----------------------------------------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT content_hash FROM passages WHERE content_hash IS NOT NULL AND content_hash NOT IN (SELECT content_hash FROM embedding_cache WHERE model_digest = '{MODEL}' AND prefix = '{PREFIX}' AND content_hash IS NOT NULL)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages whose vector the cache lacks."""
    cache = table(spark, sf_dir, "embedding_cache").where((c("model_digest") == MODEL) & (c("prefix") == PREFIX))
    return lineage.cache_misses(table(spark, sf_dir, "passages").where("content_hash IS NOT NULL"), cache, ["content_hash"])


@query(f"""
WITH {P_SQL}, f AS (SELECT content_hash, min(published_at) AS first FROM p GROUP BY 1), d AS (SELECT DISTINCT doc, content_hash FROM p WHERE published_at >= DATE '{AS_OF}')
SELECT doc, count(*) AS n, count(*) FILTER (WHERE first >= DATE '{AS_OF}') AS fresh FROM d JOIN f USING (content_hash) GROUP BY doc""")
def reuse_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what was published since a day, how much is new text."""
    rows = passages(spark, sf_dir)
    day = F.lit(AS_OF).cast("date")
    return lineage.reuse(rows.where(c("published_at") >= day), rows.where(c("published_at") < day), ["doc"], "content_hash")


_LIMBS = ", ".join(f"sum(('0x' || h[{8 * i + 1}:{8 * i + 8}])::UBIGINT::HUGEINT) AS s{i}" for i in range(8))


@query(f"""
WITH {P_SQL}, h AS (SELECT doc, sha256(concat_ws(' ', coalesce(content_hash, 'None'), coalesce(ref, 'None'), coalesce(valid_from::VARCHAR, 'None'), coalesce(valid_to::VARCHAR, 'None'))) AS h FROM p),
s AS (SELECT doc, count(*) AS rows, {_LIMBS} FROM h GROUP BY doc)
SELECT doc, rows, sha256(concat_ws(' ', rows, {", ".join(f"s{i}" for i in range(8))})) AS fingerprint FROM s""")
def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest a document, whatever the order of its passages."""
    text = lineage.line(c("content_hash"), c("ref"), c("valid_from"), c("valid_to"))
    return lineage.fingerprint(passages(spark, sf_dir), ["doc"], text)


@query("WITH g AS (SELECT DISTINCT ON (gen_id) * FROM generations WHERE ruling_id IS NOT NULL) SELECT ruling_id, count(*) AS runs, count(DISTINCT coalesce(sha256(text), 'None')) AS outputs, count(DISTINCT coalesce(sha256(text), 'None')) = 1 AS same FROM g GROUP BY ruling_id")
def repeatability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions asked several times: whether they always got the same answer."""
    rows = table(spark, sf_dir, "generations").where("ruling_id IS NOT NULL").dropDuplicates(["gen_id"])
    return lineage.repeatable(rows, ["ruling_id"], "text")


@query("WITH r AS (SELECT DISTINCT ruling_id, category FROM rulings), o AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256('20261002/' || ruling_id), ruling_id) AS draw FROM r) SELECT category, ruling_id, draw FROM o WHERE draw <= 20")
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rulings of each category to be read by a person (a sampling operator)."""
    rows = table(spark, sf_dir, "rulings").select("ruling_id", "category").distinct()
    return lineage.stratified_sample(rows, "category", "ruling_id", 20261002, 20).select("category", "ruling_id", "draw")


@query(f"WITH {P_SQL} SELECT passage_id, valid_from + ((valid_to - valid_from) // 2)::INT AS midpoint FROM p WHERE valid_to IS NOT NULL AND valid_from IS NOT NULL AND valid_to >= valid_from")
def window_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day halfway through each closed window: when a question about the old text would be dated."""
    rows = passages(spark, sf_dir).where("valid_to IS NOT NULL AND valid_from IS NOT NULL AND valid_to >= valid_from")
    return rows.select("passage_id", temporal.midpoint(c("valid_from"), c("valid_to")).alias("midpoint"))


@query(f"WITH {P_SQL} SELECT doc, version, count(DISTINCT r) AS known FROM (SELECT doc, version, unnest(refs) AS r FROM p) GROUP BY ALL")
def known_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rules the passages of each version carry."""
    rows = passages(spark, sf_dir).select("doc", "version", F.explode("refs").alias("r"))
    return rows.groupBy("doc", "version").agg(F.countDistinct("r").alias("known"))


@query("""
WITH m AS (SELECT doc_id, rater, max(toxic) AS mark FROM doc_labels GROUP BY ALL) SELECT x.mark AS first, count(*) FILTER (WHERE y.mark = 0) AS "0", count(*) FILTER (WHERE y.mark = 1) AS "1", count(*) AS total
FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.rater < y.rater GROUP BY x.mark""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of the first rater of a document against those of the others."""
    return evaluate.crosstab(_rater_pairs(spark, sf_dir).withColumn("y", c("y").cast("string")), "x", "y", ["0", "1"]).withColumnRenamed("x", "first")


_HISTORY = f"""WITH rv AS (SELECT DISTINCT ON (document_id, number) split_part(document_id, '@', 1) AS doc, {_VERSION} AS v, number, text FROM rules WHERE number IS NOT NULL AND text IS NOT NULL),
la AS (SELECT doc, max(v) AS latest FROM rv GROUP BY doc), o_r AS (SELECT doc || '@' || array_to_string(v, '.') AS e, number, text FROM rv JOIN la USING (doc) WHERE v < latest),
n_r AS (SELECT DISTINCT e, number, text FROM rv JOIN la USING (doc) JOIN (SELECT DISTINCT e, split_part(e, '@', 1) AS doc FROM o_r) USING (doc) WHERE v = latest), {align_sql('o_r', 'n_r', 'e')},
nw2 AS (SELECT split_part(e, '@', 1) AS doc, list_transform(string_split(split_part(e, '@', -1), '.'), lambda x: CAST(x AS INT)) AS v, * FROM matched), mx AS (SELECT doc, max(v) AS newest FROM nw2 GROUP BY doc),
jd AS (SELECT doc, new_number AS number, max(CASE WHEN v = newest AND old_number IS NOT NULL THEN 1 ELSE 0 END) AS known,
  min(CASE WHEN old_number IS NOT NULL THEN (regexp_replace(old_text, '{XREF_SQL}', 'rule #', 'g') = regexp_replace(new_text, '{XREF_SQL}', 'rule #', 'g'))::INT END) AS same FROM nw2 JOIN mx USING (doc) WHERE new_number IS NOT NULL GROUP BY ALL)"""


@query(f"{_HISTORY} SELECT doc, number, CASE WHEN known = 0 THEN 'new' WHEN same = 1 THEN 'stable' ELSE 'changed' END AS status FROM jd")
def rule_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule of a document's latest edition: new, stable or changed over all older editions."""
    rules = table(spark, sf_dir, "rules").where("number IS NOT NULL AND text IS NOT NULL").dropDuplicates(["document_id", "number"])
    rules = rules.select(F.substring_index("document_id", "@", 1).alias("doc"), temporal.version_key(F.substring_index("document_id", "@", -1)).alias("v"), "number", "text")
    latest = rules.groupBy("doc").agg(F.max("v").alias("latest"))
    marked = rules.join(latest, "doc")
    old = marked.where("v < latest").select("doc", c("v").alias("edition"), "number", "text")
    new = marked.where("v = latest").select("doc", "number", "text").join(old.select("doc", "edition").distinct(), "doc")
    return align.rule_history(align.align(old, new, ["doc", "edition"]), "doc", "edition")


@query(f"""{_HISTORY}, hs AS (SELECT number, CASE WHEN known = 0 THEN 'new' WHEN same = 1 THEN 'stable' ELSE 'changed' END AS status FROM jd WHERE doc = 'core'),
la2 AS (SELECT array_to_string(max(v), '.') AS latest FROM rv WHERE doc = 'core'), q AS (SELECT DISTINCT ON (ruling_id) ruling_id, faq_backed, rule_numbers FROM rulings WHERE question IS NOT NULL),
u AS (SELECT ruling_id, unnest(rule_numbers) AS n, generate_subscripts(rule_numbers, 1) AS i FROM q), j AS (SELECT ruling_id, i, n, coalesce(status, 'unknown') AS status FROM u LEFT JOIN hs ON hs.number = n),
a AS (SELECT ruling_id, string_agg('core@' || latest || ':' || n, ' ' ORDER BY i) AS expect, string_agg(status, ' ' ORDER BY i) AS statuses, bool_or(status = 'changed') AS stale FROM j, la2 GROUP BY ruling_id)
SELECT ruling_id, CASE WHEN faq_backed THEN 'expert-ruling-faq' ELSE 'expert-ruling' END AS stratum, coalesce(expect, '') AS expect, coalesce(statuses, '') AS statuses, coalesce(stale, false) AS stale_text_exists FROM q LEFT JOIN a USING (ruling_id)""")
def ruling_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rulings as questions: what they expect of the latest edition, what became of each rule that they cite, and whether older wordings could mislead."""
    asked = table(spark, sf_dir, "rulings").where("question IS NOT NULL").dropDuplicates(["ruling_id"]).select("ruling_id", "faq_backed", "rule_numbers")
    version = F.substring_index("document_id", "@", -1)
    latest = table(spark, sf_dir, "rules").where("number IS NOT NULL AND text IS NOT NULL AND document_id LIKE 'core@%'").agg(F.array_join(F.max(temporal.version_key(version)).cast("array<string>"), ".").alias("v")).scalar()
    history = rule_history(spark, sf_dir).where("doc = 'core'").select(c("number").alias("n"), "status")
    each = asked.select("ruling_id", F.posexplode("rule_numbers").alias("i", "n")).join(history, "n", "left")
    one = F.struct("i", F.concat(F.lit("core@"), c("v"), F.lit(":"), c("n")).alias("ref"), F.coalesce("status", F.lit("unknown")).alias("status"))
    cited = each.withColumn("v", latest).groupBy("ruling_id").agg(F.array_sort(F.collect_list(one)).alias("cited"))
    rows = asked.join(cited, "ruling_id", "left")
    listed = lambda field: F.coalesce(F.array_join(F.transform("cited", lambda x: x[field]), " "), F.lit(""))
    return rows.select(
        "ruling_id", F.when(c("faq_backed"), "expert-ruling-faq").otherwise("expert-ruling").alias("stratum"), listed("ref").alias("expect"), listed("status").alias("statuses"),
        F.coalesce(F.exists("cited", lambda x: x["status"] == "changed"), F.lit(False)).alias("stale_text_exists"),
    )


# --- streams (extension) and plain relational work --------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts and sums from a stream of events, drained once."""
    rows = updates.run_once(updates.hourly(updates.source(spark, f"{sf_dir}/events.parquet"), "ts", ["event_type"], "value", "1 day"), "complete")
    return rows.select(c("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered aggregation over the largest relational table."""
    rows = table(spark, sf_dir, "lineitem").where(c("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT r_name, n_name, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def sales_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star join with subtotals."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("orders").join(t("customer"), c("o_custkey") == c("c_custkey")).join(t("nation"), c("c_nationkey") == c("n_nationkey")).join(t("region"), c("n_regionkey") == c("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '1998-01-01')")
def idle_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anti join: customers without an order in the last year."""
    recent = table(spark, sf_dir, "orders").where(c("o_orderdate") >= F.lit("1998-01-01").cast("date"))
    return table(spark, sf_dir, "customer").join(recent, c("o_custkey") == c("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, row_number() OVER w AS place, lag(o_orderkey) OVER w AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with a frame, a rank and a predecessor."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(frame), 2).alias("running"), F.row_number().over(w).alias("place"), F.lag("o_orderkey").over(w).alias("previous"))


@query("SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and difference."""
    t = lambda name, key: table(spark, sf_dir, name).select(c(key).alias("nation"))
    return t("supplier", "s_nationkey").intersect(t("customer", "c_nationkey")).subtract(table(spark, sf_dir, "nation").where("n_regionkey = 0").select(c("n_nationkey").alias("nation")))
