import hashlib
import math
import random

import numpy as np
import pytest

from issuelens.llm import clustering as C

SCHEMA = "vec_id long, embedding array<float>"


def lloyd(rows, k=C.K, rounds=C.ROUNDS):
    """Plain rounds in Python integers: (vec_id, cluster, distance) and the centroids."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(centers)):
            mine = [v for (_, v), (_, o) in zip(kept, own) if o == j]
            if mine:
                centers[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, j, d) for (i, _), (d, j) in zip(kept, assign())], centers


def vectors(n, seed, spread=0.2):
    r = random.Random(seed)
    hubs = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(9)]
    out = [[h + r.gauss(0, spread) for h in r.choice(hubs)] for _ in range(n)]
    return [(i, v if r.random() > 0.2 else out[0]) for i, v in enumerate(out)]  # a fifth are copies


def check(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, centers = lloyd(rows)
    got = C.query(spark, str(tmp_path)).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        assert r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster)
        assert r.inertia == sum(d for _, _, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centers[r.cluster])).encode()).hexdigest()


def test_equals_plain_rounds(spark, tmp_path, monkeypatch):
    check(spark, tmp_path, vectors(400, 1))


def test_odd_rows(spark, tmp_path):
    rows = vectors(60, 2)
    rows += [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63),
             (105, [float("nan")] * 64), (106, [float("inf")] + [0.0] * 63), (None, [0.5] * 64), (None, [0.25] * 64),
             (5, rows[5][1]), (5, rows[6][1]), (107, [0.0] * 64), (108, [-1e4] * 64)]
    check(spark, tmp_path, rows)


@pytest.mark.parametrize("n", [1, 3])
def test_fewer_vectors_than_centroids(spark, tmp_path, n):
    check(spark, tmp_path, vectors(n, 3))


def test_empty_table_and_other_columns(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    assert C.query(spark, f"{tmp_path}/a").count() == 0
    rows = vectors(50, 4)
    df = spark.createDataFrame([(*r, "mine", 1.5) for r in rows], f"{SCHEMA}, cluster string, v double")
    df.write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert sorted((r.vec_id, r.cluster, r.distance) for r in C.query(spark, f"{tmp_path}/b").collect()) == sorted(lloyd(rows)[0])


def test_heaps_spare_settled_vectors(spark):
    # well separated hubs: after the first passes nearly no vector is compared with all centroids again
    r = random.Random(6)
    rows = [(i, [float(10 * (i % 40 == j)) + r.gauss(0, 0.01) for j in range(64)]) for i in range(800)]
    v = C.integer_vectors(spark.createDataFrame(rows, SCHEMA))
    start = np.array([[2560 * (i == j) for j in range(64)] for i in range(40)], np.int64)
    found, centers, scanned = C.cluster(spark, v, start)
    assert scanned[0] == 800 and sum(scanned[1:]) < 80
    assert {(x.id, x.cluster) for x in found.collect()} == {(i, i % 40) for i in range(800)}


def test_large_components_stay_exact(spark):
    big = float(1 << 19)
    rows = [(0, [big] * 64), (1, [big + 0.25] * 64), (2, [-big] * 64), (3, [1e30] * 64)]
    v = C.integer_vectors(spark.createDataFrame(rows, SCHEMA)).orderBy("id").collect()
    assert [x.v[0] for x in v] == [1 << 27, 1 << 27, -1 << 27, 1 << 27]
    x = np.array([[C.LIMIT] * 64, [-C.LIMIT] * 64, [3] * 64], np.int64)
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in x] for p in x]
    assert C.squared_distances(x, x).tolist() == exact
