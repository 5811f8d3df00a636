import random
import re

from pyspark.sql import functions as F

from chronotext.llm import neardup

SCHEMA = "rule_id bigint, number string, text string, key string, n int, class_id string"


def classes(spark, data):
    df = spark.createDataFrame([(*r, "clash", 1, "clash") for r in data], SCHEMA)
    return neardup.text_classes(df, row_id=F.col("rule_id"), text=neardup.without_number(F.col("text"), F.col("number")))


def found(spark, data):
    members, kinds = classes(spark, data)
    return sorted(tuple(r) for r in neardup.near_copies(members, neardup.class_pairs(kinds)).collect())


def grams(text):
    w = re.findall(r"[a-z0-9']+", text.lower().replace("’", "'"))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 12 else set()


def brute(texts):
    sets = [(i, grams(t)) for i, t in texts]
    return sorted({(min(i, j), max(i, j)) for i, a in sets for j, b in sets if i < j and a and b and len(a & b) / len(a | b) >= 0.5})


def test_numbers_at_the_head_are_not_text(spark):
    body = "every player who draws a card must show it to all of the others at once"
    data = [(i, "10.1.a", t) for i, t in enumerate([body, f"10.1.a. {body}", f"[10.1.a] {body}", f"(10.1.a) {body}", f"10.1.a {body.upper()}", f"  10.1.a.\n{body}"])]
    _, kinds = classes(spark, data)
    assert kinds.count() == 1 and len(found(spark, data)) == 15
    other = [(1, "10.1", f"10.1.a {body}"), (2, "10.1", body)]
    assert classes(spark, other)[1].count() == 2


def test_nulls_short_empty_repeated(spark):
    body = "one two three four five six seven eight nine ten eleven twelve"
    data = [(1, "1", None), (2, "1", ""), (3, "1", "  "), (None, "1", body), (4, None, body), (4, None, body), (5, "1", body.rsplit(" ", 1)[0]), (6, "1", body), (7, "1", "Reserved.")]
    assert found(spark, data) == [(4, 6)]
    assert found(spark, []) == []


def test_against_brute_force_with_a_hot_group(spark):
    rng = random.Random(3)
    names = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(120):
        w = [rng.choice(names) for _ in range(rng.randrange(8, 60))]
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randrange(0, 8)):
                v.insert(rng.randrange(len(v)), rng.choice(names))
            if rng.random() < 0.3:
                v = v[len(v) // 2 :] + v[: len(v) // 2]
            texts.append(" ".join(v))
    texts += ["a common sentence that stands in very many places of this book again and again " + rng.choice(["", "x", "y z"]) for _ in range(60)]
    data = [(i, str(i), t) for i, t in enumerate(texts)]
    assert found(spark, data) == brute(list(enumerate(texts)))


def test_report_has_one_row_an_id(spark):
    body = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    members, kinds = classes(spark, [(1, "1", body), (2, "2", body), (3, "3", body + " more"), (4, "4", "entirely other words stand in this text so that nothing is shared at all here")])
    report = {r.id: (r.class_id, r.links) for r in neardup.copy_report(members, neardup.class_pairs(kinds)).collect()}
    assert report == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 0)}
