import numpy as np
import pytest

from chronotext.llm import defects

Q = "Can the silver courier block twice during the final showdown?"
GENERATIONS = "gen_id bigint, ruling_id string, text string, done_reason string, question string, labels string"
CASES = {
    "empty": [None, "", " \n\t", "N/A", "...", "**Answer:**", "<p></p>", "```\n```", "null", "(no answer)", "​"],
    "refusal": [
        "I'm sorry, but I can't help with that.", "The passages do not contain the answer.", "As a language model I cannot give rulings on card games.", "No comment on this; that is a matter for the head judge.",
        "Lo siento, no puedo responder a esa pregunta.", Q + " Unfortunately I must decline to rule on that interaction.", "I have to pass on this one.",
    ],
    "copy": [Q, Q.upper(), f"Question: {Q}", f"{Q} {Q}", Q.replace("silver ", ""), f'"{Q}"', f"> {Q}\n\nQuestion: {Q}\nAnswer:"],
    "language": ["Der Kurier kann nicht zweimal blocken, weil das Finale schon begonnen hat.", "El mensajero no puede bloquear dos veces durante el final.", "審判によると、裏向きの間は攻撃できません。"],
    "truncated": ["Yes. The courier may block twice because the condition is", "The courier blocks once per turn [core@1.2:5", "You keep four markers; the courier goes to the upper lane and stays bu"],
}
GOOD = [
    "Yes.", "No", "**No.**", "Yes, once.", "The courier may block twice, since the showdown is one phase [core@1.2:512.3].", f"Question: {Q}\nAnswer: The courier blocks only once in a turn.",
    "You can't, since the courier is already exhausted; the second block is refused.", "I cannot see any reason it would fail: the courier blocks and the warden pays two marks.",
    'The printed card says "Les deux joueurs piochent", which means the same.', "The order is up to the judge, so it may. [core@1.4:326.9]", "Sorry for the confusion earlier: the courier does block twice in the final.",
]


def table(spark, texts, known=True):
    rows = [(i, "r" if known else "lost", t, "stop", "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, GENERATIONS), spark.createDataFrame([("r", Q, "clash"), ("r", Q, "clash"), (None, "x", "y"), ("n", None, "z")], "ruling_id string, question string, text string")


def test_each_defect_and_what_looks_like_one(spark):
    texts, wanted = [], []
    for kind, cases in CASES.items():
        texts += cases
        wanted += [kind] * len(cases)
    texts += GOOD * 4
    wanted += [None] * len(GOOD) * 4
    got = {r.gen_id: r.labels for r in defects.defects(*table(spark, texts)).collect()}
    assert {i: (got[i][0] if got[i] else None) for i in got} == dict(enumerate(wanted))


def test_without_a_question_nothing_is_said_of_copy_and_language(spark):
    texts = [Q, "Der Kurier kann nicht zweimal blocken.", "", "I am unable to answer this question."] + GOOD
    got = {r.gen_id: r.labels for r in defects.defects(*table(spark, texts, known=False)).collect()}
    assert got[0] == [] and got[1] == [] and got[2] == ["empty"] and got[3] == ["refusal"]


def test_nulls_repeats_and_empty_tables(spark):
    g, r = table(spark, ["", "Yes."] + GOOD)
    twice = g.unionByName(g).unionByName(g.limit(1).selectExpr("CAST(NULL AS BIGINT) gen_id", "ruling_id", "text", "done_reason", "question", "labels"))
    assert defects.defects(twice, r).count() == g.count()
    assert defects.defects(g.limit(0), r).collect() == []


def test_label_model_finds_the_reliable_functions():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.1
    votes = np.stack([np.where(rng.random(4000) < q, truth, rng.random(4000) < 0.05) for q in (0.95, 0.9, 0.85, 0.3)], 1)
    keys = ["".join("1" if v else "0" for v in row) for row in votes]
    counts = {k: keys.count(k) for k in set(keys)}
    prior, rate = defects.fit(counts)
    assert prior[1] == pytest.approx(0.1, abs=0.03) and rate[1, 0] > rate[1, 3]
    score = dict(zip(counts, defects.posterior(prior, rate, list(counts))))
    cut = defects.cutoff(np.array(list(score.values())), np.array(list(counts.values())))
    assert np.mean([(score[k] >= cut) == t for k, t in zip(keys, truth)]) > 0.97


def test_very_long_answers_are_read_whole():
    assert defects.votes("The courier may block. " * 20_000 + "And then it", "stop", Q)["truncated"][0] == 1


def test_edit_share_is_levenshteins():
    import random

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1] / max(len(a), len(b))

    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(1, 90))) for _ in range(2))
        assert defects._edit_share(a, b) == slow(a, b)
    assert defects._edit_share("", "x") == 1.0 and defects._edit_share("same", "same") == 0.0


def test_a_name_is_no_refusal_and_an_echoed_question_no_answer():
    refusal = lambda text, q: defects.votes(text, "stop", q)["refusal"]
    assert not any(refusal("You cannot choose Rulanan again before scoring, but the lancer remains a legal target.", Q)[:5])
    assert refusal("¿Puede el mensajero bloquear dos veces? Prefiero no opinar.", None)[5] == 1


def test_a_language_without_known_words_is_told_by_its_sequences(spark):
    english = ["Does the warden block before the courier moves?", "May the herald pay two marks when the round is over?", "Which player takes the token if both of them pass?", "Can the lancer attack again after it was turned to the side?"] * 30
    german = ["Darf der Wächter vor dem Boten blocken, wenn die Runde vorbei ist?", "Welche Karte nimmt der Spieler, der zuerst an der Reihe war?"] * 30
    asked = spark.createDataFrame([(str(i), q) for i, q in enumerate(english + german)], "ruling_id string, question string")
    known = defects.profiles(asked)
    assert known.languages == ["de", "en"]
    swedish, turkish = "spelaren tar tillbaka kortet eftersom rundan redan är slut", "oyuncu kartı geri alır çünkü tur zaten sona ermiştir"
    assert known.speaks(turkish, "en") is None or known.speaks(turkish, "en") == 1
    assert known.speaks(swedish, "en") == 1 and known.speaks("the courier moves after the warden was turned", "en") == 0
    assert known.speaks("short", "en") is None and known.speaks(swedish, "fi") is None
    assert defects.profiles(asked.limit(0)).speaks(swedish, "en") is None
