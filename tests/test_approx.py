import random

from pyspark.sql import functions as F

from issuelens.operators import approx as X
from issuelens.operators.search import SearchSpec, search

SPEC = SearchSpec(filter_cols=())


def vectors(n, seed, dim=16, hubs=40):
    r = random.Random(seed)
    centers = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(hubs)]
    return [[c + r.gauss(0, 0.03) for c in centers[i % hubs]] for i in range(n)]


def test_buckets_find_near_chunks_among_few_pairs(spark):
    coll = spark.createDataFrame([(f"c{i:04}", f"p{i}", v) for i, v in enumerate(vectors(1200, 1))],
                                 "id string, parent string, embedding array<double>").repartition(3)
    qs = spark.createDataFrame([(i, v) for i, v in enumerate(vectors(60, 1))], "question_id long, vector array<double>")
    b = X.Buckets(tables=6, projections=3, width=0.8)
    exact, found = search(spark, coll, qs, SPEC), X.search_approx(spark, coll, qs, SPEC, b)
    assert X.recall(found, exact).first().recall >= 0.9
    scores = {(r.question_id, r.id): r.score for r in exact.collect()}
    assert all(scores.get((r.question_id, r.id), r.score) == r.score for r in found.collect())
    model = X.fit(spark, 16, b)
    met = X.keyed(coll, "embedding", model, b).select("id", "bucket").join(
        X.keyed(qs, "vector", model, b).select("question_id", "bucket"), "bucket").select("id", "question_id").distinct().count()
    assert met < 0.2 * 1200 * 60


def test_one_place_for_a_chunk_in_many_tables_and_windows(spark):
    rows = [(f"c{i}", f"p{i}", [0.01 * i, 0.0], "c0" if i < 30 else f"c{i}") for i in range(40)]
    coll = spark.createDataFrame(rows, "id string, parent string, embedding array<double>, chunk_id string")
    coll = coll.withColumn("parent", F.when(F.col("chunk_id") == "c0", "p0").otherwise(F.col("parent")))
    qs = spark.createDataFrame([(1, [0.0, 0.0])], "question_id long, vector array<double>")
    out = X.search_approx(spark, coll, qs, SPEC, X.Buckets(tables=4, projections=1, width=4.0)).orderBy("rank").collect()
    assert [r.id for r in out] == ["c0", "c30", "c31", "c32", "c33"] and [r["rank"] for r in out] == [1, 2, 3, 4, 5]


def test_no_questions_and_null_vectors(spark):
    coll = spark.createDataFrame([("a", "a", [1.0]), ("b", "b", None)], "id string, parent string, embedding array<double>")
    none = spark.createDataFrame([], "question_id long, vector array<double>")
    assert X.search_approx(spark, coll, none, SPEC).count() == 0
    qs = spark.createDataFrame([(1, [1.0]), (2, None)], "question_id long, vector array<double>")
    assert [(r.question_id, r.id) for r in X.search_approx(spark, coll, qs, SPEC).collect()] == [(1, "a")]
