import collections
import datetime as dt
import random
import re

from pyspark.sql import functions as F

from chronotext.operators import snapshots
from chronotext.operators.snapshots import snapshot_changes

SCHEMA = "doc string, snap_no int, delivered_at timestamp, number string, text string, similarity double, hash string, old boolean"


def changes(spark, data, **kw):
    rows = [(a, b, dt.datetime(2025, 1, 1) + dt.timedelta(hours=t) if t is not None else None, n, x, s, "clash", True) for a, b, t, n, x, s in data]
    c = F.col
    return snapshot_changes(spark.createDataFrame(rows, SCHEMA), doc=c("doc"), snap=c("snap_no"), delivered=c("delivered_at"), number=c("number"), text=c("text"), score=c("similarity"), **kw)


def canon(t):
    return " ".join(t.translate(str.maketrans("‘’“”", "''\"\"")).split())


def shingles(t):
    w = re.findall(r"[a-z0-9']+", t.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or ({tuple(w)} if w else set())


def order(n):
    return [x.rjust(10, "0") if x.isdigit() else x for x in n.split(".")]


def brute(data):
    """Pairs one by one in descending similarity; texts must have no ties in it."""
    latest, snaps = {}, collections.defaultdict(dict)
    for a, b, t, n, x, s in data:
        latest[a, b] = max(latest.get((a, b), t), t)
    for a, b, t, n, x, s in data:
        snaps[a, b] = snaps[a, b]
        if n is not None and x is not None and t == latest[a, b]:
            snaps[a, b][n, canon(x)] = s
    out = set()
    for a in {k[0] for k in snaps}:
        nums = sorted(k[1] for k in snaps if k[0] == a)
        for lo, hi in zip(nums, nums[1:]):
            old, new = snaps[a, lo], snaps[a, hi]
            for k in old.keys() & new.keys():
                if None not in (old[k], new[k]) and abs(old[k] - new[k]) > 0.001:
                    out.add((a, hi, k[0], k[0], "rescored"))
            o = sorted(old.keys() - new.keys(), key=lambda k: order(k[0]))
            n = sorted(new.keys() - old.keys(), key=lambda k: order(k[0]))
            for x in list(o):
                if y := next((y for y in n if y[1] == x[1]), None):
                    out.add((a, hi, x[0], y[0], "moved"))
                    o.remove(x)
                    n.remove(y)
            edges = []
            for x in o:
                for y in n:
                    p, q = shingles(x[1]), shingles(y[1])
                    if p and q and len(p & q) / len(p | q) >= 0.5:
                        edges.append((-len(p & q) / len(p | q), x, y))
            for _, x, y in sorted(edges):
                if x in o and y in n:
                    out.add((a, hi, x[0], y[0], "changed"))
                    o.remove(x)
                    n.remove(y)
            out |= {(a, hi, x[0], "", "removed") for x in o} | {(a, hi, "", y[0], "added") for y in n}
    return sorted(out, key=repr)


def test_each_kind(spark, rows):
    long = "every player draws two cards and then puts one of them under the deck"
    data = [
        ("d", 1, 0, "1", long, 1.0), ("d", 1, 0, "2", "same “text” here", 0.5), ("d", 1, 0, "3", "gone without a trace", None), ("d", 1, 0, "4", "moves along", 1.0), ("d", 1, 0, "5", "scored again", 0.5),
        ("d", 4, 1, "1", long + " again", 1.0), ("d", 4, 1, "2", "same \n\"text\"  here", 0.5005), ("d", 4, 1, "9", "moves along", 1.0), ("d", 4, 1, "5", "scored again", 0.6), ("d", 4, 1, "6", "something entirely new", None),
    ]
    assert rows(changes(spark, data)) == sorted([("d", 4, "1", "1", "changed"), ("d", 4, "4", "9", "moved"), ("d", 4, "5", "5", "rescored"), ("d", 4, "3", "", "removed"), ("d", 4, "", "6", "added")], key=repr)


def test_deliveries_nulls_and_empty(spark, rows):
    data = [
        ("d", 1, 0, "1", "faulty", None), ("d", 1, 5, "1", "right", None), ("d", 1, 5, "1", "right", None), ("d", 1, 5, None, "x", None), ("d", 1, 5, "7", None, None),
        ("d", 2, 9, "1", "right", 0.1), ("d", 2, 9, "2", "", 0.1), (None, 2, 9, "1", "a", 0.1), ("e", None, 9, "1", "a", 0.1), ("solo", 3, 1, "1", "x", 1.0),
        ("f", 1, 0, "1", "x y z", 0.1), ("f", 2, 0, None, None, 0.1),
    ]
    assert rows(changes(spark, data)) == [("d", 2, "", "2", "added"), ("f", 2, "1", "", "removed")]
    assert rows(changes(spark, [])) == []


def test_copies_are_paired_in_order_and_never_twice(spark, rows):
    text = "all of these rules say the very same thing in the very same words"
    data = [("d", 1, 0, f"{i}", text, None) for i in range(1, 13)] + [("d", 2, 1, f"{i}", text, None) for i in range(21, 26)] + [("d", 2, 1, f"{i}", text + " now", None) for i in range(31, 34)]
    kinds = collections.Counter(r[4] for r in rows(changes(spark, data)))
    assert kinds == {"moved": 5, "changed": 3, "removed": 4}
    assert ("d", 2, "2", "22", "moved") in rows(changes(spark, data))


def test_against_brute_force(spark, rows):
    rng = random.Random(7)
    names = [f"w{i}" for i in range(400)]
    data = []
    for doc in ("a", "b"):
        book = {f"{i}.{rng.randrange(9)}": " ".join(rng.choice(names) for _ in range(rng.randrange(1, 40))) for i in range(60)}
        for snap in (1, 3, 4):
            data += [(doc, snap, snap, n, t.replace(" ", rng.choice([" ", "  ", "\n"])), round(rng.choice([1.0, 0.9, rng.random()]), 3)) for n, t in book.items()]
            new = {}
            for n, t in book.items():
                w = t.split()
                roll = rng.random()
                if roll < 0.1:
                    continue
                if roll < 0.3:
                    for _ in range(rng.randrange(1, 4)):
                        w.insert(rng.randrange(len(w) + 1), rng.choice(names))
                new[n if rng.random() < 0.8 else f"9{len(new)}.1"] = " ".join(w)
            book = new | {f"7{snap}{i}": " ".join(rng.choice(names) for _ in range(9)) for i in range(3)}
    assert rows(changes(spark, data)) == brute(data)


def test_large_comparisons_go_by_rounds(spark, rows):
    rng = random.Random(11)
    edges = [("d", s, bytes([i]), bytes([100 + j]), rng.choice([0.5, 0.6, 0.75, 0.9]), 1 + i % 3, 1 + j % 2) for s in (1, 2) for i in range(12) for j in range(12) if rng.random() < 0.4]
    # A chain of ever better partners: each round settles one pair.
    edges += [("chain", 1, bytes([i]), bytes([100 + i + k]), 0.5 + (2 * i + k) / 200, 1, 1) for i in range(12) for k in (0, 1)]
    df = spark.createDataFrame(edges, "doc string, snap int, old_hash binary, new_hash binary, sim double, n_old bigint, n_new bigint")
    whole = rows(snapshots.greedy_pairs(df))
    assert rows(snapshots.greedy_pairs(df, group_edges=20)) == whole and len(whole) > 20
    assert rows(snapshots.greedy_pairs(df.limit(0))) == []
