import datetime as dt
import random

from pyspark.sql import functions as F

from chronotext.functions.text import reference, unversioned
from chronotext.operators.asof import attributes_as_known, known_intervals

SCHEMA = "passage_id bigint, source_ref string, published_at date, valid_from date, valid_to date, entity string, bucket int"
EVENTS = "candidate_id string, about string, as_of date, event_id string, at string"


def d(n):
    return None if n is None else dt.date(2025, 1, 1) + dt.timedelta(n)


def run(spark, passages, events, width=7, min_rows=None):
    p = spark.createDataFrame([(i, r, d(a), d(b), d(c), "clash", 1) for i, r, a, b, c in passages], SCHEMA)
    e = spark.createDataFrame([(i, r, d(a), "clash", "clash") for i, r, a in events], EVENTS)
    ref = reference(F.col("source_ref"))
    known = known_intervals(p, row_id=F.col("passage_id"), series=ref, entity=unversioned(ref), published=F.col("published_at"), valid_from=F.col("valid_from"), valid_to=F.col("valid_to"))
    return attributes_as_known(e, known, event_id=F.col("candidate_id"), entity=unversioned(reference(F.col("about"))), at=F.col("as_of"), bucket_days=width)


def brute(passages, events):
    norm = lambda r: r.strip(" .\t ").lower()
    rule = lambda r: norm(r).split("@")[0] + ":" + norm(r).split(":", 1)[1]
    out = set()
    for i, about, day in events:
        if day is None or about is None:
            continue
        latest = {}
        for p in passages:
            if p[1] is not None and p[2] is not None and rule(p[1]) == norm(about) and p[2] <= day:
                latest[norm(p[1])] = max(latest.get(norm(p[1]), p), p, key=lambda x: (x[2], x[0]))
        held = [p for p in latest.values() if p[3] is not None and p[3] <= day and (p[4] is None or day < p[4])]
        if held:
            out.add((i, max(held, key=lambda p: (p[3], p[2], p[0]))[0]))
    return sorted(out, key=repr)


def test_bounds_restatement_and_future_knowledge(spark, rows):
    passages = [
        (1, "core@1.0:100.1", 0, 5, 20), (2, " CORE@1.0:100.1. ", 15, 5, 18),  # restated: ends earlier
        (3, "core@1.1:100.1", 30, 18, None), (4, "core@1.1:100.2", 0, 0, 10),
    ]
    events = [("before", "core:100.1", 4), ("first", "core:100.1", 5), ("gap", "core:100.1", 18), ("unknown yet", "core:100.1", 29), ("later", "Core:100.1 ", 30), ("end", "core:100.2", 10), ("other", "core:9", 5)]
    assert rows(run(spark, passages, events)) == [("first", 1), ("later", 3)]


def test_nulls_empty_and_repeated(spark, rows):
    passages = [(1, "a@1.0:1", 0, 0, None)] * 3 + [(2, None, 0, 0, None), (3, "a@1.0:2", None, 0, None), (4, "a@1.0:3", 0, None, None), (5, "a@1.0:4", 0, 3, 3)]
    events = [("e", "a:1", 3)] * 2 + [("n", "a:1", None), ("x", None, 3), ("y", "a:2", 3), ("z", "a:3", 3), ("w", "a:4", 3)]
    assert rows(run(spark, passages, events)) == [("e", 1)]
    assert rows(run(spark, [], events)) == [] and rows(run(spark, passages, [])) == []


def test_ties_go_to_the_highest_row(spark, rows):
    passages = [(1, "a@1.0:1", 0, 0, None), (2, "a@1.0:1", 0, 0, None), (3, "a@1.1:1", 0, 0, None)]
    assert rows(run(spark, passages, [("e", "a:1", 1)])) == [("e", 3)]


def test_against_brute_force(spark, rows):
    rng = random.Random(4)
    passages = []
    for i in range(300):
        start = rng.randrange(60)
        passages.append((i, f"core@1.{rng.randrange(3)}:{rng.randrange(4)}", rng.randrange(60), start, None if rng.random() < 0.2 else start + rng.randrange(30)))
    events = [(f"c{i}", f"core:{rng.choice([0, 0, 0, 1, 2, 3])}", rng.randrange(70)) for i in range(400)]
    assert rows(run(spark, passages, events)) == brute(passages, events)


def test_one_odd_date_multiplies_nothing(spark, rows):
    passages = [(1, "a@1.0:1", 0, 0, None), (2, "a@1.0:2", 0, 0, None)]
    assert rows(run(spark, passages, [("e", "a:1", 1), ("far", "a:1", 2_900_000), ("f", "a:2", 3)])) == [("e", 1), ("f", 2), ("far", 1)]
