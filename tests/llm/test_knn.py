import numpy as np

from chronotext.llm import knn

SCHEMA = "content_hash string, model_digest string, prefix string, embedding array<float>, id bigint, bucket int, names string"


def found(spark, data, **kw):
    df = spark.createDataFrame([(h, m, p, None if v is None else [None if x is None else float(x) for x in v], 7, 7, "clash") for h, m, p, v in data], SCHEMA)
    return {tuple(r) for r in knn.nearest(df, **kw).collect()}


def brute(data, dims=64, top=5):
    groups = {}
    for h, m, p, v in data:
        if None not in (h, m, p) and v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v) and any(v):
            groups.setdefault((m, p), {})[h] = np.asarray(v, float) / np.linalg.norm(v)
    out = set()
    for (m, p), vs in groups.items():
        hs = sorted(vs)
        x = np.stack([vs[h] for h in hs])
        s = x @ x.T
        np.fill_diagonal(s, -2)
        for i, row in enumerate(s):
            for j in np.argsort(-row, kind="stable")[:top]:
                if row[j] >= 0.9:
                    out.add((m, p, min(hs[i], hs[j]), max(hs[i], hs[j])))
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 64))
    near = [b / np.linalg.norm(b) + rng.normal(size=64) * rng.uniform(0.005, 0.05) for b in base for _ in range(rng.integers(1, 4))]
    data = [(f"h{i:05}", "m", "p" if i % 5 else "q", v.astype("f4") * rng.uniform(0.2, 9)) for i, v in enumerate([*base, *near])]
    got, want = found(spark, data), brute(data)
    assert len(want) > 300 and len(got & want) >= 0.97 * len(want) and got <= want


def test_unusable_vectors_nulls_and_repeats(spark):
    v = np.eye(64)[0] + 0.01
    bad = [v[:63], np.zeros(64), np.where(np.arange(64) == 3, np.nan, v), np.where(np.arange(64) == 3, np.inf, v), [], None, [None] + [1.0] * 63]
    data = [("a", "m", "", v), ("a", "m", "", v), ("b", "m", "", v * 2 + 0.001), ("c", "n", "", v), ("d", "m", "x", v), (None, "m", "", v), ("e", None, "", v)]
    data += [(f"bad{i}", "m", "", b) for i, b in enumerate(bad)]
    assert found(spark, data) == {("m", "", "a", "b")}
    assert found(spark, []) == set()


def test_copies_of_one_vector_stay_linear(spark):
    v = np.arange(1.0, 65.0)
    data = [(f"h{i:03}", "m", "p", v) for i in range(200)] + [("z", "m", "p", v + 0.5)]
    got = found(spark, data)
    assert len(got) <= 201 * 5 and {("m", "p", "h000", f"h{i:03}") for i in range(1, 200)} <= got
    assert sum("z" in r[2:] for r in got) == 5


def test_probes_come_in_the_order_of_their_score():
    sets = knn.probe_sets(10, 8)
    assert sets[0] == (0,) and sets[1] == (1,) and len(set(sets)) == 8
    assert all(not any(19 - j in s for j in s) for s in knn.probe_sets(10, 200))
