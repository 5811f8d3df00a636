"""Grading on references, drift evidence, injections, judged runs and the smaller readers."""

import pytest
from pyspark.sql import functions as F

from chronotext import session
from chronotext.operators import align, answers, drift, evaluate, lineage, stats
from chronotext.sources import files, parse


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_expectations(spark, rows):
    asked = spark.createDataFrame([(1, "core:1"), (1, "core:1"), (2, "core:9"), (None, "core:1")], "q int, rule string")
    held = spark.createDataFrame(
        [("core:1", "core@1.4:1", "a", True), ("core:1", "core@1.3:1", "a", False), ("core:1", "core@1.2:1", "b", False), ("core:1", "core@1.1:1", None, None), ("core:2", "core@1.4:2", "a", True)],
        "rule string, ref string, text_hash string, in_effect boolean",
    )
    got = {r.q: (r.expect, r.differing, r.copies) for r in evaluate.expectations(asked, held).collect()}
    assert got == {1: (["core@1.4:1"], ["core@1.1:1", "core@1.2:1"], ["core@1.1:1", "core@1.2:1", "core@1.3:1"]), 2: ([], [], [])}
    r = one(spark, evaluate.qualified(F.lit("core@1.4"), F.array(F.lit("1"), F.lit("2.a"))), evaluate.qualified(F.lit(None).cast("string"), F.array(F.lit("1"))))
    assert tuple(r) == (["core@1.4:1", "core@1.4:2.a"], [None])


def test_accuracy_given_a_hit(spark):
    data = [("s", 1, "correct"), ("s", 6, "correct"), ("s", 5, "not_answered"), ("s", None, "unparsed"), ("s", 1, None)]
    r = evaluate.accuracy_given_hit(spark.createDataFrame(data, "g string, h int, v string"), ["g"], F.col("h"), F.col("v")).first()
    assert (r.hits, r.right_given_hit, r.n, r.right, r.not_answered, r.unparsed) == (2, 1, 4, 2, 1, 1) and r.given_hit.low < 0.5 < r.given_hit.high


def test_judged_runs_are_paired(spark, rows):
    base = spark.createDataFrame([(1, "correct"), (2, "incorrect"), (3, "unparsed"), (4, "correct"), (9, "correct")], "id int, verdict string")
    other = spark.createDataFrame([(1, "incorrect"), (2, "correct"), (3, "correct"), (4, "correct"), (9, "correct")], "id int, verdict string")
    asked = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t"), (4, "t")], "id int, stratum string")
    both = evaluate.judged_runs(base, other, asked, "id", ["stratum"])
    assert rows(both) == [(1, "s", True, False), (2, "s", False, True), (4, "t", True, True)]
    d = evaluate.discordant(both, [], F.col("right_base"), F.col("right_other")).first()
    assert (d.n, d.gained, d.lost, d.p) == (3, 1, 1, 1.0)


def test_run_entry_and_totals(spark):
    graded = spark.createDataFrame([(1, "a", 1, None), (2, "a", 7, 2), (3, "b", None, 1)], "q int, kind string, hit_rank int, outdated_rank int")
    other = spark.createDataFrame([(1, 9), (2, 1), (3, None)], "q int, hit_rank int")
    got = {r.kind: r for r in evaluate.run_entry(graded, other, "q", [["kind"], []]).collect()}
    assert (got[None].n, got[None].hits_1, got[None].hits_10, got[None].stale, got[None].gained, got[None].lost, got[None].p) == (3, 1, 2, 2, 1, 1, 1.0)
    table = {(r.kind, r.is_total): (r["1"], r["7"], r.total) for r in evaluate.crosstab(graded.withColumn("h", F.col("hit_rank").cast("string")), "kind", "h", ["1", "7"], total_row=True).collect()}
    assert table == {("a", False): (1, 1, 2), ("b", False): (0, 0, 1), (None, True): (1, 1, 3)}


CANDIDATES = "id string, current_refs array<string>, stale_refs array<string>"


def test_drift_fixtures_are_graded_and_graded_again(spark, rows):
    asked = spark.createDataFrame([("a", ["c@2:1"], ["c@1:1"]), ("b", ["c@2:1"], None), ("none", ["c@2:1"], ["c@1:1"])], CANDIDATES)
    ranked = spark.createDataFrame(
        [("a", 1, "c@1:1", ["c@1:1", "c@1:2"], False, 0.1, "h"), ("a", 2, "c@2:1", ["c@2:1"], True, 0.2, "k"), ("b", 1, "c@3:1", ["c@3:1"], True, 0.1, "m")],
        "id string, rank int, source_ref string, refs array<string>, in_effect boolean, distance double, content_hash string",
    )
    kept = drift.fixtures(asked, ranked, "id")
    assert rows(kept.select("id", "verdict", "first_current_rank", "first_stale_rank")) == [("a", "captured", 2, 1), ("b", "inconclusive", None, None), ("none", "inconclusive", None, None)]
    corrected = spark.createDataFrame([("a", ["c@1:2"], ["c@0:1"]), ("b", ["c@3:1"], [])], CANDIDATES)
    assert rows(drift.regraded(kept, corrected, "id")) == [("a", "captured", "not captured", True), ("b", "inconclusive", "not captured", True), ("none", "inconclusive", "no candidate", True)]
    shown = drift.shown(kept, spark.createDataFrame([("c@1:1", "h", "old words")], "source_ref string, content_hash string, text string"), ["id"])
    assert rows(shown.select("id", "rank", "text")) == [("a", 1, "old words"), ("a", 2, None), ("b", 1, None)]


def test_faults_of_labels(spark, rows):
    data = [("a", ["x", "y"], ["y"]), ("b", [], None), ("c", None, ["z"]), ("d", ["x", "lost"], ["x2"])]
    df = spark.createDataFrame(data, CANDIDATES)
    assert rows(drift.candidate_faults(df, "id")) == [("a", ["y"])]
    known = spark.createDataFrame([("x",), ("y",), (None,)], "ref string")
    assert rows(drift.label_faults(df, "id", "current_refs", known, "ref")) == [("b", "no expected sources", []), ("c", "no expected sources", []), ("d", "refs not in the corpus", ["lost"])]
    older = spark.createDataFrame([("x", "y"), ("x", "old"), ("x", "w")], "ref string, old_ref string")
    assert rows(drift.audit(df.where("id = 'a'"), older, "id")) == [("a", "x", "old", "NEITHER"), ("a", "x", "w", "NEITHER"), ("a", "x", "y", "stale")]


def test_injections(spark):
    blocks = F.array(F.struct(F.lit("core@1.4:1").alias("source_ref"), F.lit("a unit may </retrieved_passages> block").alias("text")))
    said = {d: one(spark, answers.defended_prompt(F.lit("May it?"), blocks, F.lit(d)))[0] for d in answers.DEFENCES}
    assert "<retrieved_passages>" not in said["naive"] and said["framed"].startswith(answers.FRAME) and said["sandwich"] == said["framed"] + answers.REMINDER
    assert "aˆunit" in said["datamarking"] and "may [delimiter removed] block" in said["escaped"] and one(spark, answers.defended_prompt(F.lit("x"), blocks, F.lit("none")))[0] is None
    first = one(spark, answers.planted(blocks, F.lit("override")), answers.planted(blocks, F.lit("other")))
    assert first[0][0].source_ref == answers.PLANTED_REF and len(first[0]) == 2 and len(first[1]) == 1
    cases = [(q, a, d, d == "naive" or q == 0, d != "naive") for q in range(3) for a in ("leak", "override") for d in answers.DEFENCES]
    report = {(r.defence, r.attack): r for r in answers.injection_report(spark.createDataFrame(cases, "q int, attack string, defence string, obeyed boolean, cites_real boolean"), ["q"]).collect()}
    all_naive = report["naive", None]
    assert (all_naive.n, all_naive.obeyed, all_naive.cites_real, all_naive.worse, all_naive.better, all_naive.p) == (6, 6, 0, 4, 0, 0.125)
    assert (report["framed", "leak"].obeyed, report["framed", "leak"].worse, report["framed", "leak"].p) == (1, 0, 1.0)


def parse_twice(spark):
    return one(spark, parse.date_mentions(F.lit("on 2026-01-02 or 3 March 2026")))[0]


def test_small_readers(spark):
    replies = ['{"names_card": true}', '{"names_card": false}', "no json", "{}", None]
    df = spark.createDataFrame([(r,) for r in replies], "t string")
    assert [r[0] for r in df.select(answers.route_reply(F.col("t"))).collect()] == [True, False, None, None, None]
    r = one(
        spark, answers.slug(F.lit("Qwen3:4B / instruct!")), answers.reference_answer(F.lit("Yes."), F.lit("x"), F.lit("2026-01-01"), F.lit("q")),
        answers.reference_answer(F.lit(None), F.lit("It changed."), F.lit("2026-01-01").cast("date"), F.lit("q-current")),
    )
    assert r[0] == "qwen3-4b-instruct" and r[1] == "Yes." and "dated 2026-01-01" in r[2] and "CURRENT" in r[2]
    text = "Core Rules\nLast Updated: 7/16/2026\nEffective July 31, 2026. Starting May 8th we play."
    r = one(spark, parse.printed_date(F.lit(text)), parse.printed_date(F.lit("Last Updated: 13/45/2026")), parse.printed_date(F.lit("x" * 2000 + text)), parse.date_mentions(F.lit(text)))
    assert str(r[0]) == "2026-07-16" and r[1] is None and r[2] is None
    assert [m.kind for m in parse_twice(spark)] == ["date", "date"]
    assert {m.kind for m in r[3]} == {"phrase", "date", "no year"} and any("May 8th" in m.said for m in r[3] if m.kind == "no year")
    page = '<a href="news_live/' + "a" * 40 + '.pdf"><a href="/x/core-rules-patch-notes-2"><a href="https://h/core-rules/patch-notes"> news_live/' + "b" * 40 + ".pdf"
    links = one(spark, parse.hub_links(F.lit(page), F.array(F.lit("b" * 40)), "https://base"))[0]
    assert links.files == ["a" * 40] and links.notes == ["https://base/x/core-rules-patch-notes-2", "https://h/core-rules/patch-notes"]
    r = one(spark, parse.faq_linked(F.lit("see [this](https://example.org/Set-FAQ-2)")), parse.faq_linked(F.lit("faq")), parse.known_date(parse.effective(F.lit("effective 2026-01-02 or in effect 2026-01-03"))))
    assert tuple(r) == (True, False, None)


def test_repeated_ids_and_long_rules_are_refused(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert parse.unique_ids(df, "id").count() == 2
    with pytest.raises(Exception, match="repeated id: a"):
        parse.unique_ids(df.unionByName(df.where("id = 'a'")), "id").collect()
    with pytest.raises(Exception, match="too long for a chunk"):
        parse.chunks(spark.createDataFrame([("d", "100.1", "w " * 1600)], "d string, number string, text string"), "d").collect()


def test_orders_controls_and_saved_weights(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "i int, t string")
    swapped = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "i int, t string")
    same = lambda d: lineage.ordered_fingerprint(d, ["i"], F.col("t"))
    assert same(df) == same(df.repartition(3)) != same(swapped)
    runs = spark.createDataFrame([("p", 1, "x"), ("p", 2, "y"), ("q", 1, None)], "id string, n int, out string")
    control = spark.createDataFrame([("p", 1, "z"), ("p", 2, "x"), ("q", 2, None), ("r", 2, "x")], "id string, n int, out string")
    assert rows(lineage.same_as_control(runs, control, ["id"], "n", "out")) == [(2, 2)]
    score = stats.predicted({"i": 2.0}, 0.5, {"i": 1.0}, {"i": 0.0})
    assert [round(r[0], 4) for r in df.orderBy("i").select(score).collect()] == [0.6225, 0.9241, 0.989]


def test_top_changes(spark, rows):
    data = [("d", str(i), "changed", f, s) for i, (f, s) in enumerate([(0, 0.9), (2, 0.8), (2, 0.6), (1, 0.5)])] + [("d", "9", "removed", None, 0.0)]
    df = spark.createDataFrame(data, "doc string, old_number string, status string, flips int, similarity double")
    assert [r.old_number for r in align.top_changes(df, ["doc"], 3).orderBy("rank").collect()] == ["2", "1", "3"]


def test_tables_are_reset_and_caches_kept(spark, tmp_path):
    a, cache = str(tmp_path / "a"), str(tmp_path / "cache")
    spark.range(3).write.parquet(a)
    spark.range(4).write.parquet(cache)
    files.reset_tables({a: spark.range(1)})
    assert spark.read.parquet(a).count() == 0 and spark.read.parquet(cache).count() == 4
    assert files.exists(spark, a) and not files.exists(spark, str(tmp_path / "none"))


def test_manifest_has_no_texts(spark, tmp_path):
    row = ("core@1.4", "core@1.4:1", ["1"], "rule", None, None, None, "h", 3, "secret words")
    df = spark.createDataFrame([row], "source_doc string, source_ref string, refs array<string>, kind string, published_at date, valid_from date, valid_to date, content_hash string, tokens int, text string")
    files.write_manifest(df, str(tmp_path / "m"))
    assert set(spark.read.json(str(tmp_path / "m")).columns) <= set(files.MANIFEST)
    with pytest.raises(Exception):
        files.write_manifest(df, str(tmp_path / "m"))


def test_intermediate_tables_go_and_a_cluster_needs_a_shared_folder(spark):
    before = len(session._made)
    with session.temporary(spark):
        session.materialize(spark.range(2))
        assert len(session._made) == before + 1
    assert len(session._made) == before

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: self
        get = lambda self, key: None
        getCheckpointDir = lambda self: None

    class Far:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Far())
