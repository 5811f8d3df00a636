import re

from pyspark.sql import functions as F

from chronotext.llm import leaks

ITEM = "granted that the seventh lancer sleeps does any courier owe twelve marks to the warden or none"
DOCS = "doc_id bigint, text string, item_id string, start string"
ITEMS = "item_id bigint, text string, doc_id string"


def run(spark, docs, items, what=leaks.leaks):
    d = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], DOCS)
    i = spark.createDataFrame([(n, t, "clash") for n, t in items], ITEMS)
    return sorted(tuple(r) for r in what(d, i, doc_id=F.col("doc_id"), text=F.col("text"), item_id=F.col("item_id"), item_text=F.col("text")).collect())


def test_disguises(spark):
    part = " ".join(ITEM.split()[2:13])
    docs = [
        part.upper(), part.replace(" ", "\n  "), part.replace("lancer", "<b>lan</b>cer"), part.replace(" ", "&nbsp;"), part.replace("sleeps", "slee-\n  ps"), part.replace("sleeps", "slee\u00ad\r\nps"), part.replace("courier", "cou​rier"),
        part.replace("twelve", "twelve,—"), "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in part), f"before <p>{part}</p> after", part.replace("seventh", "s&#101;venth"),
    ]
    assert run(spark, list(enumerate(docs)), [(7, ITEM)]) == [(i, 7) for i in range(len(docs))]


def test_ten_words_in_a_row(spark):
    w = ITEM.split()
    docs = [(0, " ".join(w[:10])), (1, " ".join(w[:9])), (2, " ".join(w[:5] + ["well"] + w[5:12])), (3, " ".join(w[3:9] + w[10:16])), (4, " ".join(w[-10:])), (5, None), (6, ""), (None, ITEM), (4, " ".join(w[-10:]))]
    assert run(spark, docs, [(1, ITEM), (2, ITEM), (2, ITEM), (3, "too short"), (4, None), (None, ITEM)]) == [(0, 1), (0, 2), (4, 1), (4, 2)]
    assert run(spark, [], [(1, ITEM)]) == [] and run(spark, docs, []) == []


def test_places_in_the_original(spark):
    text = "é &amp; <i>x</i> " + ITEM.replace("courier", "cou-\nrier") + " end"
    [(doc, item, start, stop)] = run(spark, [(1, text)], [(9, ITEM)], leaks.leak_spans)
    assert (doc, item) == (1, 9) and text[start:stop] == ITEM.replace("courier", "cou-\nrier")


def test_several_passes_and_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(leaks, "AUTOMATON_WORDS", 20)
    other = re.sub("e", "u", ITEM)
    assert run(spark, [(1, "word " * 200_000 + ITEM), (2, other)], [(1, ITEM), (2, other), (3, ITEM)]) == [(1, 1), (1, 3), (2, 2)]


COMPOUND = "the herald of a well-known northern house pays no toll while the twin moons are up"


def test_places_of_a_compound_wrapped_at_its_hyphen(spark):
    wrapped = COMPOUND.replace("well-", "well-\n")
    short = " ".join(wrapped.split(" ")[:9])
    both = wrapped.replace("twin", "tw-\nin")
    shy = ITEM.replace("courier", "cou&shy;\nrier")
    kana = COMPOUND.replace("pays", "\u304b\u3099\u304b")
    items = [(1, COMPOUND), (2, ITEM), (3, kana.replace("\u304b\u3099", "\u304c"))]
    docs = list(enumerate(["a. " + wrapped + " z", short, both, shy, kana, "<p>" + wrapped + "</p> " + ITEM, COMPOUND]))
    spans = run(spark, docs, items, leaks.leak_spans)
    assert sorted({(d, i) for d, i, _, _ in spans}) == run(spark, docs, items) == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 3), (5, 1), (5, 2), (6, 1)]
    assert [docs[d][1][a:b] for d, _, a, b in spans] == [wrapped, short, both, shy, kana, wrapped, ITEM, COMPOUND]


def test_each_hyphen_is_read_for_itself(spark):
    mixed = COMPOUND.replace("well-", "well-\n").replace("northern", "nor-\nthern").replace("toll", "to-\nll")
    chain = COMPOUND.replace("northern", "n-\no-\nr-\nt-\nh-\ne-\nr-\nn")
    docs = [(0, mixed), (1, "x-\ny " + mixed + " z-\nw"), (2, " ".join(mixed.split(" ")[:8])), (3, chain), (4, "-\n" + COMPOUND.replace("a well", "a-\nwell"))]
    items = [(1, COMPOUND), (2, COMPOUND.replace("northern", "nor-\nthern"))]
    spans = run(spark, docs, items, leaks.leak_spans)
    assert sorted({(d, i) for d, i, _, _ in spans}) == run(spark, docs, items)
    assert run(spark, docs, items[:1]) == [(0, 1), (1, 1), (3, 1), (4, 1)]
    texts = dict(docs)
    assert [texts[d][a:b] for d, i, a, b in spans if i == 1 and d < 2] == [mixed, mixed]


def brute(item, text, run=10):
    """Every reading of every hyphen at a line end."""
    def readings(t):
        parts = re.split(r"(?<=[a-z])-\n(?=[a-z])", t)
        out = [parts[0]]
        for part in parts[1:]:
            out = [o + j + part for o in out for j in ("", " ")]
        return [re.findall("[a-z]+", o) for o in out]
    windows = lambda t: {tuple(w[i : i + run]) for w in readings(t) for i in range(len(w) - run + 1)}
    return bool(windows(item) & windows(text))


def test_readings_against_brute_force():
    import random

    rng = random.Random(8)
    names = "ab cd ef gh".split()
    for _ in range(300):
        item = "".join(rng.choice(names) + rng.choice([" ", " ", " ", "-\n"]) for _ in range(rng.randrange(4, 9))).strip("-\n ")
        text = "".join(rng.choice(names) + rng.choice([" ", " ", "-\n"]) for _ in range(rng.randrange(4, 11))).strip("-\n ")
        text = text + " " + item.replace(" ", rng.choice([" ", "-\n"]), 1) if rng.random() < 0.5 else text
        windows = leaks.Windows([(1, item)], 4)
        assert (windows.found(text) == {1}) == brute(item, text, 4), (item, text)
        assert {i for i, _, _ in windows.spans(text)} == windows.found(text)
