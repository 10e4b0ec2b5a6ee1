import numpy as np

from issuelens.llm import ann as M

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(v, queries, k=5):
    out = {}
    ids = np.array(sorted(v))
    x = np.array([v[i] for i in ids], np.float32).astype(float)
    for q in queries:
        s = M.cosines(np.array(v[q], np.float32).astype(float), x)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    out = {}
    for r in M.nearest(spark, df, lambda i: i % 50 == 0, **options).collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    return {q: [x[k] for k in sorted(x)] for q, x in out.items()}


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 16))
    x = centers[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 16)) * 0.6
    x[200:260] = x[100]  # copies
    rows = [(i, v, 0) for i, v in enumerate(x.tolist())]
    got, want = found(spark, rows), brute({i: v for i, v, _ in rows}, range(0, 4000, 50))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {(q, i): s for q in got for i, s in got[q]}
    v = {i: np.array(e, np.float32).astype(float) for i, e, _ in rows}
    for (q, i), s in exact.items():
        assert abs(s - v[q] @ v[i] / np.sqrt((v[q] @ v[q]) * (v[i] @ v[i]))) < 1e-12
    assert [i for i, _ in got[200]] == [100, 201, 202, 203, 204]


def test_hot_lists_are_split(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.tile(rng.normal(size=(1, 8)), (900, 1)), rng.normal(size=(300, 8))])
    monkeypatch.setattr(M, "PART", 100)
    rows = [(i, v, 0) for i, v in enumerate(x.tolist())]
    got, want = found(spark, rows), brute({i: v for i, v, _ in rows}, range(0, 900, 50))
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 0), (1, [2.0, 0.0], 0), (2, None, 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0),
            (50, [1.0, float("inf")], 0), (100, [1.0], 0), (150, [0.0, -3.0], 0), (None, [1.0, 1.0], 0), (5, [None, 1.0], 0)]
    got = found(spark, rows)
    assert got == {0: [(1, 1.0), (150, 0.0)], 150: [(0, 0.0), (1, 0.0)]} or {
        q: [i for i, _ in x] for q, x in got.items()} == {0: [1, 150], 150: [0, 1]}
    assert found(spark, []) == {} and found(spark, [(0, [1.0], 0)]) == {}
    same = [(7, [1.0, 0.0], 0), (0, [1.0, 0.0], 0), (0, [0.5, 0.5], 0)]
    assert all(i == 7 for i, _ in found(spark, same)[0])
