"""Golden cases and brute-force versions of the library's own operators."""

import datetime as dt
import difflib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from chronotext.functions import text as tx
from chronotext.operators import align, answers, evaluate, lineage, retrieval, stats, temporal
from chronotext.sources import files, parse
from chronotext.streaming import updates


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def day(s):
    return None if s is None else dt.date.fromisoformat(s)


# --- time ---


def test_half_open_windows(spark):
    cases = [("2025-01-01", "2025-01-01", "2025-02-01", True), ("2025-02-01", "2025-01-01", "2025-02-01", False), ("2030-01-01", "2025-01-01", None, True), ("2024-12-31", "2025-01-01", None, False)]
    df = spark.createDataFrame([(day(a), day(b), day(c), w) for a, b, c, w in cases], "d date, a date, b date, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", temporal.in_force(F.col("d"), F.col("a"), F.col("b"))).collect())


def test_windows_are_refused_with_reasons(spark):
    data = [("x", "1.2", "2025-01-10", "2025-01-01"), ("x", "1.9", "2025-02-10", "2025-02-01"), ("x", "1.10", None, "2025-03-01"), ("x", "1.11", "2025-04-10", "2025-05-01"), ("x", "1.12", "2025-04-10", "2025-04-01"), ("y", "1.0", "2025-04-10", "2025-04-01")]
    df = spark.createDataFrame([(a, b, day(c), day(d)) for a, b, c, d in data], "doc string, version string, e date, p date")
    got = {(r.doc, r.version): (r.valid_from, r.valid_to, r.refused) for r in temporal.validity_windows(df, ["doc"], "version", "e", "p").collect()}
    assert got["x", "1.2"] == (day("2025-01-10"), day("2025-02-10"), None)
    assert [got["x", v][2] for v in ("1.9", "1.10", "1.11")] == ["successor date unknown", "effective date unknown", "effective before printed date"]
    assert got["x", "1.12"] == (day("2025-04-10"), None, None) == got["y", "1.0"]


def test_pending_versions_compare_as_numbers(spark, rows):
    r = spark.createDataFrame([("x", "1.9"), ("x", "1.10"), ("z", "0.1")], "doc string, version string")
    i = spark.createDataFrame([("x", "1.9"), ("x", "1.2")], "doc string, version string")
    assert rows(temporal.pending(r, i, ["doc"], "version")) == [("x", "1.10"), ("z", "0.1")]


# --- text ---


def test_words_and_shingles(spark):
    df = spark.createDataFrame([(0, "Don’t STOP, 3x now"), (1, "two words"), (2, "?!"), (3, None), (4, "")], "i int, t string")
    got = {r.i: r for r in df.withColumn("w", tx.words(F.col("t"))).withColumn("n", F.size(tx.shingles(F.col("w")))).collect()}
    assert got[0].w == ["don't", "stop", "3x", "now"] and [got[i].n for i in (0, 1, 2, 4)] == [2, 1, 0, 0] and got[3].w is None


def test_canonical_of_clean_and_odd_texts(spark):
    cases = [("plain text", "plain text"), (" one blank ", "one blank"), ("a  b", "a b"), ("a b\n", "a b"), ("a\nb", "a b"), ("a\u00a0b", "a b"), ("a\u0085\u2003b\n", "a b"), ("it’s “so”", "it's \"so\""), ("", ""), ("\t", ""), (None, None)]
    df = spark.createDataFrame(cases, "t string, want string")
    assert [r.got for r in df.withColumn("got", tx.canonical(F.col("t"))).collect()] == [w for _, w in cases]


def test_canonical_and_references(spark):
    r = one(spark, tx.canonical(F.lit(" a \n “b” ’c ")), tx.reference(F.lit("  CORE@1.3:419.4. ")), tx.unversioned(F.lit("core@1.3:419.4")), tx.number_key(F.lit("9.a.10")))
    assert tuple(r) == ("a \"b\" 'c", "core@1.3:419.4", "core:419.4", "0000000009.a.0000000010")


# --- statistics ---


def test_closed_forms(spark):
    r = one(spark, stats.wilson(F.lit(18), F.lit(20)), stats.wilson(F.lit(0), F.lit(0)), stats.mcnemar_p(F.lit(6), F.lit(0)), stats.mcnemar_p(F.lit(11), F.lit(22)), stats.mcnemar_p(F.lit(0), F.lit(0)), stats.mcnemar_p(F.lit(3000), F.lit(3000)))
    assert (round(r[0].low, 2), round(r[0].high, 2)) == (0.70, 0.97) and tuple(r[1]) == (0.0, 1.0)
    assert r[2] == pytest.approx(0.03125) and r[3] == pytest.approx(stats.exact_p(22, 11)) and r[4] == 1.0 and r[5] == 1.0
    assert stats.least_discordant() == 6
    plans = [(40, 0.3, 0.9), (40, 0.3, 0.7), (12, 0.5, 0.8), (0, 0.5, 0.5), (40, 0.3, 0.9)]
    got = stats.mcnemar_power(spark.createDataFrame(plans, "n int, discordant double, gain double"))
    power = {(x.n, x.gain): x.power for x in got.collect()}
    assert got.count() == 5 and power[40, 0.9] > power[40, 0.7] > 0.05 and power[0, 0.5] == 0
    split = lambda k, n, p: math.comb(n, k) * p**k * (1 - p) ** (n - k)
    assert power[12, 0.8] == pytest.approx(sum(split(d, 12, 0.5) * split(g, d, 0.8) for d in range(13) for g in range(d + 1) if stats.exact_p(g, d - g) < 0.05))
    assert one(spark, stats.half_width(F.lit(0.5), F.lit(20)))[0] == pytest.approx((lambda w: (w.high - w.low) / 2)(one(spark, stats.wilson(F.lit(10), F.lit(20)))[0]))


def test_kappa(spark):
    pairs = [(1, 1)] * 4 + [(0, 0)] * 3 + [(1, 0)] + [(None, 1)]
    df = spark.createDataFrame(pairs, "a int, b int")
    n, agree, k = (r := stats.kappa(df, [], "a", "b").first()).n, r.agree, r.kappa
    po, pe = 7 / 8, (5 * 4 + 3 * 4) / 64
    assert (n, agree) == (8, 7) and k == pytest.approx((po - pe) / (1 - pe))
    assert stats.kappa(spark.createDataFrame([(1, 1)] * 3, "a int, b int"), [], "a", "b").first().kappa is None
    more = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs * 20)], "i int, a int, b int")
    ci = stats.bootstrap_kappa(more, "a", "b", 100).first()
    assert ci.low < k < ci.high and ci.defined == 100
    assert one(spark, stats.agreement_word(F.lit(0.77)))[0] == "substantial"


def test_calibration(spark):
    rng = random.Random(3)
    data = [(i, rng.random(), int(rng.random() < 0.6)) for i in range(224)]
    df = spark.createDataFrame(data, "i int, p double, y int")
    bins = sorted(tuple(r) for r in stats.calibration_bins(df, "i", "p", "y").collect())
    assert [b[1] for b in bins] == [45, 45, 45, 45, 44]
    data.sort(key=lambda r: (r[1], r[0]))
    cuts = [data[:45], data[45:90], data[90:135], data[135:180], data[180:]]
    mean = lambda xs: sum(xs) / len(xs)
    ece = sum(len(x) * abs(mean([r[1] for r in x]) - mean([r[2] for r in x])) for x in cuts) / 224
    got = stats.calibration(df, "i", "p", "y").first()
    base = mean([r[2] for r in data])
    assert got.ece == pytest.approx(ece) and got.brier == pytest.approx(mean([(r[1] - r[2]) ** 2 for r in data])) and got.base == pytest.approx(base * (1 - base))


def test_out_of_fold_learns(spark):
    rng = random.Random(1)
    data = [(i, x := rng.gauss(0, 1), 1.0, int(rng.random() < 1 / (1 + math.exp(-3 * x)))) for i in range(300)]
    got = stats.out_of_fold(spark.createDataFrame(data, "i int, x double, c double, y int"), "i", ["x", "c"], "y").collect()
    assert len(got) == 300 and sum((r.probability > 0.5) == (r.y == 1) for r in got) > 220


# --- retrieval and evaluation ---


def test_cosine_top_with_ties_and_odd_vectors(spark, rows):
    v = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [1.0, 1.0])]
    df = spark.createDataFrame(v, "i bigint, v array<double>")
    q = spark.createDataFrame([(9, [3.0, 0.0]), (10, [0.0, 0.0])], "q bigint, v array<double>")
    got = retrieval.cosine_top(df, q, chunk_id="i", query_id="q", vector="v", k=3)
    assert [(r.i, r["rank"]) for r in got.orderBy("rank").collect()] == [(1, 1), (2, 2), (8, 3)]
    assert rows(retrieval.cosine_top(df.limit(0), q, chunk_id="i", query_id="q", vector="v", k=3)) == []


def test_query_blocks_make_no_difference(spark, rows, monkeypatch):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)], "i bigint, v array<double>")
    ask = lambda: rows(retrieval.cosine_top(df, df.withColumnRenamed("i", "q"), chunk_id="i", query_id="q", vector="v", k=4).select("q", "i", "rank"))
    whole = ask()
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 17)
    assert ask() == whole and len(whole) == 240


def ranked(spark, *keys):
    return spark.createDataFrame([(1, k, i + 1) for i, k in enumerate(keys)], "q int, k string, rank int")


def test_fusion_pool_and_rerank(spark):
    a, b = ranked(spark, "a", "b"), ranked(spark, "b", "c")
    assert [r.k for r in retrieval.fuse([a, b], "q", "k", 3).orderBy("rank").collect()] == ["b", "a", "c"]
    pooled = retrieval.pool([a, b], "q", "k")
    assert [r.k for r in pooled.orderBy("place").collect()] == ["a", "b", "c"]
    best = retrieval.rerank(pooled, F.when(F.col("k") == "c", 2.0).otherwise(1.0), "q", "k", 2)
    assert [r.k for r in best.orderBy("rank").collect()] == ["c", "a"]
    vector, lexical = (lambda as_of, k: a), (lambda k: b)
    assert [r.k for r in retrieval.retrieve("hybrid", vector, lexical, None, "q", "k", 1).collect()] == ["b"]
    with pytest.raises(ValueError):
        retrieval.retrieve("other", vector, lexical, None, "q", "k", 1)


def test_word_search(spark, rows):
    d = spark.createDataFrame([(1, "the lancer attacks the lancer"), (2, "a lancer"), (3, None), (4, "nothing here")], "d int, t string")
    q = spark.createDataFrame([(7, "Does the LANCER win?"), (8, "the of")], "q int, t string")
    got = retrieval.word_top(d, q, doc_id="d", query_id="q", text="t", k=5).select("q", "d", "rank")
    assert rows(got) == [(7, 1, 2), (7, 2, 1)] or rows(got) == [(7, 1, 1), (7, 2, 2)]


def test_grades_recall_and_comparison(spark, rows):
    data = [(1, 1, False, True, False), (1, 2, True, False, True), (1, 3, True, False, True), (2, 1, False, False, False), (3, 1, True, False, True)]
    df = spark.createDataFrame([("s" if q < 3 else "t", *x) for x in data for q in [x[0]]], "g string, q int, rank int, want boolean, copy boolean, now boolean")
    g = evaluate.grade(df, ["q", "g"], F.col("want"), F.col("copy"), F.col("now"))
    assert rows(g.drop("g")) == [(1, 2, 1, 1), (2, None, None, None), (3, 1, None, 1)]
    recall = {r.g: (r.n, r.recall_1, r.recall_3) for r in evaluate.recall_at(g, [["g"], []]).collect()}
    assert recall == {"s": (2, 0.0, 0.5), "t": (1, 1.0, 1.0), None: (3, 1 / 3, 2 / 3)}
    assert evaluate.stale_above(g, []).first().stale == 1
    other = g.withColumn("hit_rank", F.when(F.col("q") == 2, 1).otherwise(F.col("hit_rank")))
    c = evaluate.compare(g, other, "q", []).first()
    assert (c.n, c.gained, c.lost, c.p) == (3, 1, 0, 1.0)
    states = rows(evaluate.paired(g.where("q < 3"), g.where("q > 1"), "q", ["hit_rank"]).select("q", "state"))
    assert states == [(1, "only_a"), (2, "both"), (3, "only_b")]
    with pytest.raises(Exception, match="differ in their questions"):
        evaluate.compare(g.where("q < 3"), g, "q", []).collect()


def test_misses(spark):
    cases = [(True, 5, "cards", None), (True, 6, "cards", "below-cutoff"), (True, None, "cards", "card-not-in-corpus"), (True, None, "mechanics", "rule-only"), (True, None, None, "unclassified"), (False, None, "cards", "unclassified"), (None, 1, "cards", "unclassified")]
    df = spark.createDataFrame(cases, "graded boolean, r int, c string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", evaluate.miss_category(F.col("graded"), F.col("r"), F.col("c"))).collect())


@pytest.mark.parametrize("n", [1, 2, 9, 10, 224])
def test_latency_places(spark, n):
    rng = random.Random(n)
    x = [rng.randrange(50) / 2 for _ in range(n)]
    r = evaluate.latency_summary(spark.createDataFrame([(v,) for v in [*x, None]], "v double"), [], "v").first()
    s = sorted(x)
    assert (r.n, r["median"], r.p90, r["max"]) == (n, (s[(n - 1) // 2] + s[n // 2]) / 2, s[int(0.9 * (n - 1))], s[-1])


# --- editions ---


def test_alignment(spark):
    base = "at the start of its turn a player draws one card and readies all of its units"
    old = [("d", "1", base), ("d", "2", "same text"), ("d", "3", "same text"), ("d", "4", "this rule goes away for good"), ("d", "5", "see rule 185. then stop there now and go on with the next of all the steps"), (None, "9", None)]
    new = [("d", "1", base.replace("a player", "a player must")), ("d", "3", "same text"), ("d", "8", "same text"), ("d", "6", "a brand new rule stands here"), ("d", "5", "see rule 201. then stop there now and go on with the next of all the steps")]
    schema = "doc string, number string, text string"
    got = align.what_changed(align.align(spark.createDataFrame(old + old[:1], schema), spark.createDataFrame(new, schema), ["doc"]), ["doc"]).collect()
    kinds = {(r.old_number, r.new_number): r.status for r in got}
    assert kinds == {("1", "1"): "changed", ("2", "8"): "renumbered", ("3", "3"): "unchanged", ("4", None): "removed", (None, "6"): "added", ("5", "5"): "unchanged"}
    assert next(r.flips for r in got if r.status == "changed") == 1
    changes = spark.createDataFrame(got)
    refs = spark.createDataFrame([("q", "d", "1"), ("q", "d", "7")], "id string, doc string, number string")
    assert sorted(r.status for r in align.impact(refs, changes, ["doc"], "id").collect()) == ["changed", "missing"]
    same = {r.number: r.same_text for r in align.counterparts(changes, ["doc"]).collect()}
    assert same["1"] is False and same["5"] is True
    empty = spark.createDataFrame([], schema)
    assert align.align(empty, empty, ["doc"]).collect() == []


def test_word_diff(spark):
    df = spark.createDataFrame([("draw two cards now", "draw three cards"), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(align.word_diff("a", "b")).collect()]
    assert got == ["draw [-two-] {+three+} cards [-now-]", None]
    plain = re.sub(r"\[-.*?-\] ?| ?\{\+(.*?)\+\}", r" \1", got[0]).split()
    assert plain == "draw three cards".split() and difflib


# --- answers ---


def test_reading_answers(spark):
    text = "See [core@1.2:315.2.b] and [core@1.1:101] and [core@1.2:315.2.b]. The passages do not say."
    r = one(spark, answers.citations(F.lit(text)), answers.abstains(F.lit(text)), answers.abstains(F.lit("It blocks.")), answers.escaped(F.lit("a < / Retrieved_Passages > b")), answers.short_answer(F.lit("Yes.\nBecause")), answers.obeyed(F.lit("PineApple"), F.lit("override")))
    assert tuple(r) == (["core@1.1:101", "core@1.2:315.2.b"], True, False, "a [delimiter removed] b", "yes", True)
    verdicts = ['{"verdict": "Not Answered", "reason": "x"}', 'so "verdict": "correct" maybe', '{"verdict": "great"}', "", None]
    df = spark.createDataFrame([(v,) for v in verdicts], "t string")
    assert [x[0] for x in df.select(answers.judge_verdict(F.col("t"))).collect()] == ["not_answered", "correct", "unparsed", "unparsed", "unparsed"]


def test_signals(spark):
    refs, dist = F.array(F.lit("core@1.2:100"), F.lit("core@1.1:100")), F.array(F.lit(0.2), F.lit(0.5))
    r = one(spark, *answers.signals(F.lit("core@1.2:100 says so"), F.lit(9), refs, refs, dist, lambda edition: edition == "core@1.2")).asDict()
    assert tuple(r) == answers.SIGNALS and r["top_in_effect"] == 1.0
    assert r["margin"] == pytest.approx(0.3) and r["log_answer_tokens"] == pytest.approx(math.log(10))
    assert [r[k] for k in ("top_distance", "versions_disagree", "cites_any", "cites_only_retrieved", "cites_only_in_effect", "abstains")] == [0.2, 1.0, 1.0, 1.0, 1.0, 0.0]


def test_redaction():
    passage = "When a unit enters the lane, its owner may ready one other unit there for free."
    got, n = answers.redacted(f"It says: {passage.upper()} So yes.", [("a", None), ("core@1.1:1", "x " + passage)])
    assert (got, n) == ("It says: [quoted text from core@1.1:1 removed]. So yes.", 1)
    nine = " ".join(passage.split()[:9])
    assert answers.redacted(nine, [("a", passage)]) == (nine, 0) and answers.redacted(None, []) == (None, 0)


def test_injection_cases(spark):
    grid = answers.injection_grid(spark.range(3))
    assert grid.count() == 75 and grid.distinct().count() == 75
    cases = grid.withColumn("obeyed", (F.col("defence") == "naive") | (F.col("id") == 0))
    got = {r.defence: (r.n, r.obeyed, r.gained, r.lost) for r in answers.paired_with(cases, ["id", "attack"]).collect()}
    assert got["naive"] == (15, 15, 10, 0) and got["framed"] == (15, 5, 0, 0)


# --- parsing ---


def test_stray_numbers_are_folded_back(spark):
    text = "Intro\n100. Start\nSee rule\n467. Scoring here\n100.1. One\r\n100.1.a. Sub\n100.1.b. wrapped\nline\n101. 1. A list item\n099. stray"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "no rules\nat all"), (4, "")], "d int, t string")
    got = parse.parse_rules(docs, "d", "t").orderBy("d", "place").collect()
    assert {r.d for r in got} == {1} and [r.place for r in got] == list(range(5))
    assert [(r.number, r.text) for r in got] == [("100", "Start See rule 467. Scoring here"), ("100.1", "One"), ("100.1.a", "Sub"), ("100.1.b", "wrapped line"), ("101", "1. A list item 099. stray")]


def test_longest_rise_is_longest():
    rng = random.Random(5)
    for _ in range(200):
        keys = [(rng.randrange(8),) for _ in range(rng.randrange(9))]
        subsets = [[k for i, k in enumerate(keys) if m >> i & 1] for m in range(1 << len(keys))]
        best = max(len(s) for s in subsets if all(a < b for a, b in zip(s, s[1:])))
        kept = [keys[i] for i in sorted(parse.longest_rise(keys))]
        assert len(kept) == best and all(a < b for a, b in zip(kept, kept[1:]))


def test_chunks(spark, rows):
    data = [("d", "100", "Heading"), ("d", "100.1", "one two three"), ("d", "100.1.a", "four five"), ("d", "100.1.b", "six " * 30), ("d", "100.2", "x"), ("d", "200", "alone"), ("d", None, "x"), ("d", "300", None)]
    got = {(r.source_ref, r.part): (r.refs, r.tokens) for r in parse.chunks(spark.createDataFrame(data, "d string, number string, text string"), "d", 10).collect()}
    assert got == {("100.1", 0): (["100", "100.1", "100.1.a"], 9), ("100.1", 1): (["100", "100.1.b"], 33), ("100.2", 0): (["100", "100.2"], 4), ("200", 0): (["200"], 2)}


def test_dates(spark):
    pages = [
        ("<p>These rules take effect on July 31, 2026.</p>", day("2026-07-31"), "stated"), ("goes into effect 2/30/2026", None, "no date"), ("effective 2026-01-02 ... in effect 3 March 2026", None, "ambiguous"),
        ('<script>{"datePublished": "2026-05-06T10:00"}</script>new', day("2026-05-06"), "announcement-date"), ("Effective soon. On 2026-01-01 we ate.", None, "no date"), ("x Related Articles effective 2026-01-02", None, "no date"), (None, None, "page not fetched"),
    ]
    df = spark.createDataFrame(pages, "t string, d date, b string")
    assert all(tuple(r.e) == (r.d, r.b) for r in df.withColumn("e", parse.effective(F.col("t"))).collect())


def test_references_and_registry(spark, rows):
    cases = [("core@1.4:419.4.a", None), ("core@v1.4:419", None), ("core:419", "no version"), ("core@1.4", "no rule number"), ("core@1:419", "malformed"), (" ", "empty"), (None, "empty")]
    df = spark.createDataFrame(cases, "r string, want string")
    assert all(r.got.error == r.want for r in df.withColumn("got", parse.parsed_reference(F.col("r"))).collect())
    faults = parse.registry_faults(spark.createDataFrame([("core@1.0", "a"), ("core@1.0", "b"), ("core@1", "c"), ("faq@1.0", "d"), ("faq@1.0", "d")], "id string, sha string"), "id")
    assert rows(faults) == [("core@1", "not doc@MAJOR.MINOR"), ("core@1.0", "differing entries")]


def test_rulings(spark, tmp_path):
    (tmp_path / "cards").mkdir()
    (tmp_path / "cards" / "one.mdx").write_text('---\ntitle: T\n---\n\n## May <Card name="Vorun" /> act? [#may-act]\nYes.\n<Steps><Step>See<Rule number="101.2" /></Step></Steps>\n\n## Next [#next]\nNo\n')
    got = parse.ruling_sections(files.whole_texts(spark, str(tmp_path), "*.mdx")).withColumn("body", parse.rendered(F.col("section"))).withColumn("cites", parse.cited_rules(F.col("section"))).orderBy("anchor").collect()
    assert [(r.question, r.anchor, r.cites) for r in got] == [("May Vorun act?", "may-act", ["101.2"]), ("Next", "next", [])]
    assert got[0].body == "Yes.\n- See [101.2]"
    with pytest.raises(Exception, match="unknown component"):
        one(spark, parse.rendered(F.lit('<Widget a="1">')))


# --- lineage, sources, streams ---


def test_fingerprints(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("b", None), ("c", 3)], "x string, y int")
    text = lineage.line(F.col("x"), F.col("y"))
    a, b = (lineage.fingerprint(d, [], text).first() for d in (df, df.orderBy(F.desc("x")).repartition(3)))
    assert a == b and a["rows"] == 4
    assert lineage.fingerprint(df.distinct(), [], text).first() != a
    assert one(spark, lineage.line(F.lit(None), F.lit(2)))[0] == "None 2"


def test_caches(spark, rows):
    cache = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 9), ("b", 2), ("b", 2)], "k string, v int")
    assert rows(lineage.cache_misses(new, cache, ["k"])) == [("b",)]
    assert rows(lineage.insert_ignore(cache, new, ["k"])) == [("a", 1), ("b", 2)]
    assert rows(lineage.remaining(new, cache, "k")) == [("b", 2), ("b", 2)]
    assert rows(lineage.reuse(new.withColumn("g", F.lit(1)), cache, ["g"], "k")) == [(1, 2, 1)]


def test_sinks_are_idempotent(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    path = str(tmp_path / "t")
    for _ in range(2):
        files.append_missing(df, path, ["k"])
    assert rows(spark.read.parquet(path)) == [(1, "a"), (2, "b")]
    files.write_once(df, str(tmp_path / "once"))
    with pytest.raises(Exception):
        files.write_once(df, str(tmp_path / "once"))
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "x.pdf").write_bytes(b"bytes")
    found = files.binary_files(spark, str(tmp_path / "bin"))
    assert files.verified(found, found.select("sha1")).count() == 1
    assert files.verified(found, spark.createDataFrame([("0" * 40,)], "sha1 string")).count() == 0


def test_streams(spark, tmp_path, rows):
    at = dt.datetime(2025, 1, 1)
    data = [("x", "1.0", at), ("x", "1.1", at + dt.timedelta(hours=1)), ("x", "1.1", at + dt.timedelta(hours=1))]
    spark.createDataFrame(data, "doc string, version string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: updates.source(spark, str(tmp_path / "in"))
    assert updates.run_once(updates.deduplicated(stream(), ["doc", "version"], "at")).count() == 2
    assert sorted(r.n for r in updates.run_once(updates.hourly(stream().withColumn("v", F.lit(1.0)), "at", ["doc"], "v"), "complete").collect()) == [1, 2]
    windows = updates.upsert_windows(stream(), str(tmp_path / "table"), ["doc", "version"], ["doc"], "at", "version").orderBy("version").collect()
    assert [(r.version, r.newer_exists) for r in windows] == [("1.0", True), ("1.1", False)] and windows[0].valid_until == windows[1]["at"]


def test_history_sample_and_midpoint(spark, rows):
    text = "every unit of the player who lost the last showdown is readied at once"
    changes = [
        ("d", 1, "1", text, "1", text), ("d", 2, "1", text, "1", text), ("d", 1, "2", text + " now", "2", text + " then"), ("d", 2, "2", text, "2", text + " then"),
        ("d", 1, "3", text, "3", text), ("d", 2, None, None, "3", text), ("d", 2, "9", "gone", None, None),
    ]
    df = spark.createDataFrame(changes, "doc string, edition int, old_number string, old_text string, new_number string, new_text string")
    assert rows(align.rule_history(df, "doc", "edition")) == [("d", "1", "stable"), ("d", "2", "changed"), ("d", "3", "new")]
    pool = spark.range(50).select("id", F.when(F.col("id") < 48, (F.col("id") % 2).cast("string")).alias("s"))
    drawn = rows(lineage.stratified_sample(pool, "s", "id", 7, 5).select("id", "s"))
    assert drawn == rows(lineage.stratified_sample(pool.repartition(5), "s", "id", 7, 5).select("id", "s")) and len(drawn) == 12
    assert one(spark, temporal.midpoint(F.lit("2026-01-01").cast("date"), F.lit("2026-01-04").cast("date")))[0] == day("2026-01-02")
    runs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, None)], "p int, o string")
    assert rows(lineage.repeatable(runs, ["p"], "o")) == [(1, 2, 1, True), (2, 2, 2, False)]


def test_bootstrap_kappa_draws_as_often_as_the_reference(spark):
    pairs = spark.createDataFrame([(i, i % 2, (i % 5 > 0) * (i % 2)) for i in range(60)], "i int, a int, b int")
    assert stats.bootstrap_kappa(pairs, "a", "b").first().defined == 2000


def test_all_six_methods(spark):
    lists = {"v": ranked(spark, "a", "b"), "w": ranked(spark, "b", "c")}
    asked = []

    def search(name):
        return lambda *of: asked.append((name, *of)) or lists[name].where(F.col("rank") <= of[-1])

    def keys(method, k=3):
        found = retrieval.retrieve(method, search("v"), search("w"), F.col("wanted"), "q", "k", k, lambda pooled: pooled.withColumn("wanted", F.ascii("k")))
        return [r.k for r in found.orderBy("rank").collect()]

    assert keys("lexical") == ["b", "c"] and asked == [("w", 3)]
    assert keys("rerank-vector") == ["b", "a"] and asked[1:] == [("v", True, 40)]
    assert keys("rerank") == ["c", "b", "a"] and asked[2:] == [("v", True, 20), ("w", 20)]
    assert len(retrieval.METHODS) == 6 and keys("naive") == keys("as-of") == ["a", "b"] and keys("hybrid", 1) == ["b"]


def test_hybrid_finds_what_only_words_find(spark):
    import __spark_entry__

    found = __spark_entry__.queries()["asof_hybrid"](spark, "/root/testdata/sf0.001").select("passage_id").distinct()
    with_vector = __spark_entry__.queries()["vector_topk_asof"](spark, "/root/testdata/sf0.001").select("passage_id")
    assert found.count() > 0 and found.join(with_vector, "passage_id", "left_anti").count() > 0


def test_quotes_of_every_text_of_a_reference(spark, tmp_path):
    from chronotext.plans.reference import quote_redaction

    head = "one two three four five six seven eight nine ten"
    early = head + " eleven twelve thirteen"
    spark.createDataFrame([(1, "core@1.3:419", early), (2, "core@1.3:419 ", head + " other"), (3, "core@1.3:419", "quite another wording")], "passage_id bigint, source_ref string, text string").write.parquet(f"{tmp_path}/passages.parquet")
    spark.createDataFrame([(1, f"It says {early} [core@1.3:419].")], "gen_id bigint, text string").write.parquet(f"{tmp_path}/generations.parquet")
    [row] = quote_redaction(spark, str(tmp_path)).collect()
    assert row.quotes == 1 and "thirteen" not in row.answer
