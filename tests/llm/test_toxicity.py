import random

import numpy as np
from pyspark.sql import functions as F

from chronotext.llm import toxicity

INSULTS = ["moron", "bastard", "dirtbag", "scumbag", "dipshit"]
DOCS = "doc_id bigint, text string, source string, score string, bad int"


def corpus(n=240, seed=2):
    rng = random.Random(seed)
    names = ["Vorun", "Kelim", "Tabos", "Mirad", "Sulen"]
    clean = ["The {n} card draws two markers before combat.", "Between rounds I swapped {n} for a cracked golem.", "Coverage of the late bracket: {n} against the herald.", "Insults at the table lead to a ban for {n}.", "This deck with {n} is strong against slow decks."]
    foul = ["You are a complete {i} and should quit.", "Listen {i}, next time I will break your fingers.", "Shut up you worthless {i}, nobody asked you about {n}."]
    docs, marks = [], []
    for d in range(n):
        parts = [rng.choice(clean).format(n=rng.choice(names)) for _ in range(4)]
        bad = rng.random() < 0.3
        if bad:
            word = rng.choice(INSULTS)
            word = rng.choice([word, ".".join(word), word.upper(), word.replace("o", "0"), word.replace("i", "і"), word[:2] + "​" + word[2:]])
            parts.insert(rng.randrange(4), rng.choice(foul).format(i=word, n=rng.choice(names)))
        docs.append((d, " ".join(parts), f"s{d % 3}", "clash", 9))
        mark = int(bad) if rng.random() > 0.03 else int(not bad)
        marks += [(d, "a", mark), (d, "b", int(bad)), (d, "c", None)]
    return docs, marks


def test_held_out_accuracy_and_rates(spark):
    docs, marks = corpus()
    d = spark.createDataFrame(docs, DOCS).select("doc_id", "text", "source", "score")
    m = spark.createDataFrame([x for x in marks if x[0] < 160], "doc_id bigint, rater string, toxic int")
    scores = toxicity.score(d, toxicity.fit(d, m))
    got = {r.doc_id: r.score >= 0 for r in scores.collect()}
    truth = {i: mark == 1 for i, rater, mark in marks if rater == "b"}
    assert sum(got[i] == truth[i] for i in range(160, 240)) >= 76
    rates = {r.source: r for r in toxicity.rates(scores).collect()}
    assert sum(r.documents for r in rates.values()) == 240 and all(r.rate == r.cases / r.documents for r in rates.values())


def test_odd_texts_and_missing_marks(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, "", None), (3, " \n", "a"), (4, "word " * 50_000, "a"), (5, "!!!", "a"), (5, "!!!", "a")], "doc_id bigint, text string, source string")
    m = spark.createDataFrame([(4, "a", None), (9, "a", 1), (None, "a", 1)], "doc_id bigint, rater string, toxic int")
    rows = toxicity.score(d, toxicity.fit(d, m)).collect()
    assert len(rows) == 6 and all(r.score < 0 for r in rows)
    assert toxicity.score(d.limit(0), toxicity.fit(d.limit(0), m.limit(0))).collect() == []


def test_scores_are_the_kernel_machines():
    docs, _ = corpus(30)
    texts = sorted({p for d in docs for p in toxicity.passages(d[1])})
    points = toxicity.dense(texts)
    landmarks = points[toxicity.spread_out(points, 12)]
    assert np.allclose(toxicity.kernel_rows(texts, landmarks.T), points @ landmarks.T, atol=1e-5)
    assert np.allclose((points * points).sum(1), 1, atol=1e-5)


def test_disguised_words_look_alike():
    a, b, c = toxicity.dense([" you complete scumbag ", " you complete sc_umbaag ", " the herald draws cards "])
    assert a @ b > 0.7 > 0.3 > a @ c
    assert toxicity.tidy("$CUMB​AG d.i.m ѕсum") == " scumbag dim scum " and toxicity.tidy("What a moron!  a$$") == " what a moron ass "


def test_cutoff_counts_the_whole_corpus(spark):
    held = toxicity.Held(np.array([0.3] * 6 + [0.9] * 4 + [0.3] + [-0.9] * 9), np.array([True] * 10 + [False] * 10))
    # 40 of 40,000 score above all cutoffs: a good document of the ten stands for many, so the one at 0.3 must stay out.
    rare = spark.range(40_000).selectExpr("id AS doc_id", "IF(id % 1000 = 999, 2.0D, -1.0D) AS score")
    limit, f1 = toxicity.cutoff(rare, held)
    assert 0.3 <= limit < 0.9 and abs(f1 - 8 / 14) < 1e-9
    limit, f1 = toxicity.cutoff(rare.withColumn("score", F.lit(2.0)), held)
    assert limit < 0.3 and abs(f1 - 20 / 21) < 1e-9
    assert toxicity.cutoff(rare, toxicity.Held(held.best[:10], held.bad[:10]))[0] == 0.0


def test_few_marks_set_a_cutoff_too(spark):
    docs, marks = corpus(60)
    d = spark.createDataFrame(docs, DOCS).select("doc_id", "text", "source", "score")
    m = spark.createDataFrame(marks, "doc_id bigint, rater string, toxic int")
    model = toxicity.fit(d, m)
    assert model.held_out_f1 > 0.5
    one = {r.doc_id: r.score for r in toxicity.scored(d, m).collect()}
    assert all(abs(one[r.doc_id] - r.score) < 1e-5 for r in toxicity.score(d, model).collect())


def test_marked_documents_keep_all_their_passages(spark, monkeypatch):
    docs, marks = corpus(120)
    d = spark.createDataFrame(docs, DOCS).select("doc_id", "text", "source", "score")
    m = spark.createDataFrame([x for x in marks if x[1] == "b"], "doc_id bigint, rater string, toxic int")
    monkeypatch.setattr(toxicity, "BAD_PASSAGES", 60)
    monkeypatch.setattr(toxicity, "GOOD_PASSAGES", 60)
    seen, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda x, doc, *rest: seen.append(np.bincount(doc)) or train(x, doc, *rest))
    toxicity.fit(d, m)
    assert min(c.min() for c in seen) >= min(len(toxicity.passages(x[1])) for x in docs) > 1 and seen[0].sum() < 150
    raw, held = toxicity.machine_of(d, m)
    assert len(held.best) > 120 - 2 * 60 // 3 and 0 < held.bad.sum() < len(held.best)


def test_scores_by_running_sums_are_those_of_the_features():
    docs, _ = corpus(40)
    texts = sorted({p for d in docs for p in toxicity.passages(d[1])}) + ["", " ", "ab", "a" * 3_000]
    weights = np.random.default_rng(4).normal(size=2**toxicity.HASH_BITS).astype(np.float32)
    text, bucket, weight = toxicity.features(texts)
    assert np.allclose(toxicity.weighted(texts, weights), np.bincount(text, weights[bucket] * weight, len(texts)), atol=1e-5)
    assert toxicity.weighted([], weights).tolist() == []


def test_ascii_texts_are_split_as_all_others_are():
    cases = ["One. Two! Three?", "a line\nbroken here. Next", "list:\n- one\n* two\n3) three", 'He said "no." Then left.', "gap\n\nafter", "wait... what?! yes", "s.h.i.t happens", "tab\there\x01now 12.5 w0rd", "", " \n ", "x" * 10 + " y" * 60]
    for text in cases:
        slow = [toxicity.tidy(x) for x in toxicity._SPLIT.split(text) if x and not x.isspace()]
        slow = [x for x in slow if not x.isspace()]
        if all(len(x.split()) <= toxicity.LONG for x in slow):
            assert toxicity.passages(text) == list(dict.fromkeys(slow)), text


def test_no_text_is_sorted_to_draw_marked_documents(spark):
    docs, marks = corpus(20)
    d = spark.createDataFrame(docs, DOCS).select("doc_id", "text", "source")
    plan = toxicity.labelled(d, spark.createDataFrame(marks, "doc_id bigint, rater string, toxic int"))._jdf.queryExecution().executedPlan().toString()
    taken = [line for line in plan.splitlines() if "TakeOrdered" in line]
    assert taken and not any("text" in line or "passage" in line for line in taken)
