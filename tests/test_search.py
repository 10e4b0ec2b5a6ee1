import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from issuelens.operators.search import SearchSpec, search


def coll_df(spark, rows, parts=1):
    """rows: (id, parent, status, vector)"""
    df = spark.createDataFrame([(i, p, s, [float(x) for x in v]) for i, p, s, v in rows],
                               "id string, parent string, status string, embedding array<double>")
    return df.repartition(parts) if parts > 1 else df


def q_df(spark, rows):
    return spark.createDataFrame([(q, [float(x) for x in v], s) for q, v, s in rows],
                                 "question_id bigint, vector array<double>, status string")


SPEC = dict(filter_cols=("status",))


def run(spark, coll, qs, **kw):
    spec = SearchSpec(**{**SPEC, **kw})
    return [(r.question_id, r.id, r.parent, r.score, r.rank, r.filtered)
            for r in search(spark, coll, qs, spec).orderBy("question_id", "rank").collect()]


def test_best_chunk_per_parent(spark):
    # scores are squared distances: place chunks at sqrt(score) on one axis
    coll = coll_df(spark, [("issue_42", "42", "New", [math.sqrt(0.3)]),
                           ("issue_42_chunk_1", "42", "New", [math.sqrt(0.1)]),
                           ("issue_42_chunk_2", "42", "New", [math.sqrt(0.5)])])
    out = run(spark, coll, q_df(spark, [(1, [0.0], None)]))
    assert [(r[1], r[3]) for r in out] == [("issue_42_chunk_1", 0.1)]


def test_results_ascending_and_top_k(spark):
    coll = coll_df(spark, [(f"d{i}", f"p{i}", "New", [float(i)]) for i in range(10)])
    out = run(spark, coll, q_df(spark, [(1, [0.0], None)]), top_k=3)
    assert [r[1] for r in out] == ["d0", "d1", "d2"] and [r[4] for r in out] == [1, 2, 3]
    one = coll_df(spark, [("d0", "p0", "New", [1.0])])
    assert len(run(spark, one, q_df(spark, [(1, [0.0], None)]), top_k=5)) == 1


def test_score_gate_all_or_nothing(spark):
    coll = coll_df(spark, [("a", "a", "New", [0.0]), ("b", "b", "New", [3.0])])
    q = q_df(spark, [(1, [0.0], None)])
    assert run(spark, coll, q, score_threshold=-0.1) == []
    assert len(run(spark, coll, q, score_threshold=999.0)) == 2
    # best passes, so the far hit stays too
    assert len(run(spark, coll, q, score_threshold=0.5)) == 2


def test_filter_and_fallback(spark):
    coll = coll_df(spark, [("a", "a", "New", [0.0]), ("b", "b", "Closed", [1.0])])
    q = q_df(spark, [(1, [0.0], "Closed"), (2, [0.0], "Rejected")])
    out = run(spark, coll, q)
    assert [(r[0], r[1], r[5]) for r in out if r[0] == 1] == [(1, "b", True)]
    # nothing is Rejected: retried without filters, reported as unfiltered
    assert [(r[1], r[5]) for r in out if r[0] == 2] == [("a", False), ("b", False)]
    assert [r for r in run(spark, coll, q, fallback=False) if r[0] == 2] == []


def test_empty_collection(spark):
    coll = coll_df(spark, []) if False else spark.createDataFrame(
        [], "id string, parent string, status string, embedding array<double>")
    assert run(spark, coll, q_df(spark, [(1, [0.0], None)])) == []


@pytest.mark.parametrize("dedup,top_k,metric", [(True, 5, "l2sq"), (False, 3, "l2sq"), (True, 4, "cosine")])
def test_matches_brute_force(spark, dedup, top_k, metric):
    rnd = random.Random(11)
    rows = [(f"c{i}", f"p{rnd.randint(0, 30)}", rnd.choice(["New", "Closed", None]),
             [rnd.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    qs = [(q, [rnd.gauss(0, 1) for _ in range(8)], rnd.choice([None, "New", "Closed", "Nope"])) for q in range(25)]
    got = run(spark, coll_df(spark, rows, parts=7), q_df(spark, qs), top_k=top_k, deduplicate=dedup, metric=metric)

    def dist(a, b):
        a, b = np.asarray(a), np.asarray(b)
        if metric == "cosine":
            return 1 - float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
        return float(((a - b) ** 2).sum())

    pairs = pd.DataFrame([(q, f, i, p, dist(e, v)) for q, v, st in qs for f in (True, False)
                          if f == (st is not None) or not f for i, p, s, e in rows if not f or s == st],
                         columns=["q", "f", "id", "parent", "score"])
    fetch = top_k * 4 if dedup else top_k
    one = "QUALIFY row_number() OVER (PARTITION BY q, f, parent ORDER BY round(score, 9), id) = 1" if dedup else ""
    want = duckdb.sql(f"""
        WITH near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY q, f ORDER BY round(score, 9), id) <= {fetch}),
        one AS (SELECT * FROM near {one}),
        top AS (SELECT *, row_number() OVER (PARTITION BY q, f ORDER BY round(score, 9), id) AS rank FROM one QUALIFY rank <= {top_k})
        SELECT q, id, parent, round(score, 6), rank, f FROM top QUALIFY f = max(f) OVER (PARTITION BY q) ORDER BY q, rank
        """).fetchall()
    assert [(a[0], a[1], a[2], a[4], a[5]) for a in got] == [(b[0], b[1], b[2], b[4], b[5]) for b in want]
    assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want))


def test_question_blocks_that_are_not_broadcast(spark):
    rnd = random.Random(3)
    rows = [(f"c{i}", f"c{i}", rnd.choice(["New", "Old"]), [rnd.random() for _ in range(4)]) for i in range(50)]
    qs = [(q, [rnd.random() for _ in range(4)], rnd.choice([None, "New", "Gone"])) for q in range(20)]
    a = run(spark, coll_df(spark, rows), q_df(spark, qs))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = run(spark, coll_df(spark, rows, parts=3), q_df(spark, qs).repartition(4), extra={"q_block": 3, "row_block": 5})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert a == b


def test_questions_do_not_pass_through_the_driver(spark, monkeypatch):
    DataFrame, seen = type(spark.range(0)), []
    kept = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: seen.append(df.columns) or kept(df))
    monkeypatch.setattr(DataFrame, "toPandas", lambda df: pytest.fail("questions collected"))
    rows = [(f"c{i}", f"c{i}", "New", [float(i)]) for i in range(30)]
    search(spark, coll_df(spark, rows), q_df(spark, [(q, [0.5 * q], "New" if q % 2 else None) for q in range(3000)]),
           SearchSpec(**SPEC))
    assert seen == [["q_status"]]  # the distinct filter values, to prune the scan


def test_filters_prune_partitions_of_the_scan(spark, tmp_path):
    from issuelens.operators.search import _filtered_plans, question_blocks

    rows = [(f"c{i}", f"p{i}", f"s{i % 10}", [float(i)]) for i in range(100)]
    coll_df(spark, rows).write.partitionBy("status").parquet(str(tmp_path / "c"))
    coll = spark.read.parquet(str(tmp_path / "c"))
    qs = q_df(spark, [(1, [0.0], "s3"), (2, [50.0], "s7"), (3, [9.0], None)])
    plan, = _filtered_plans(coll, question_blocks(spark, qs, ["status"]), SearchSpec(**SPEC))
    text = plan._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in text.split("\n") if "FileScan" in x and "/c]" in x)
    assert "PartitionFilters: [status" in scan and "s3" in scan and "s7" in scan
    assert {(r.question_id, r.id) for r in plan.collect()} >= {(1, "c3"), (2, "c47"), (2, "c57")}
    assert not {r.id for r in plan.collect()} - {f"c{i}" for i in range(100) if i % 10 in (3, 7)}


def test_tree_level_and_blocks_keep_results(spark):
    rnd = random.Random(5)
    rows = [(f"c{i}", f"p{i % 40}", rnd.choice(["New", None]), [rnd.random() for _ in range(6)]) for i in range(900)]
    qs = [(q, [rnd.random() for _ in range(6)], rnd.choice([None, "New"])) for q in range(30)]
    base = run(spark, coll_df(spark, rows, parts=9), q_df(spark, qs))
    tree = run(spark, coll_df(spark, rows, parts=9), q_df(spark, qs),
               extra={"fanin": 2, "row_block": 7, "q_block": 4})
    assert tree == base


def test_model_mismatch_is_refused(spark):
    coll = spark.createDataFrame([("a", "a", "New", [0.0], "m1")],
                                 "id string, parent string, status string, embedding array<double>, embed_model string")
    q = q_df(spark, [(1, [0.0], None)])
    assert len(run(spark, coll, q, extra={"embed_model": "m1"})) == 1
    with pytest.raises(ValueError):
        run(spark, coll, q, extra={"embed_model": "m2"})


def test_hit_without_parent_is_its_own_parent(spark):
    coll = coll_df(spark, [("x1", None, "New", [0.1]), ("x2", None, "New", [0.2]), ("y", "p", "New", [0.3])])
    out = run(spark, coll, q_df(spark, [(1, [0.0], None)]))
    assert [(r[1], r[2]) for r in out] == [("x1", "x1"), ("x2", "x2"), ("y", "p")]


def test_group_of_copies_stays_bounded(spark):
    from issuelens.operators.search import candidates

    rnd = random.Random(9)
    copy = [0.5, 0.5, 0.5]
    rows = [(f"c{i:04d}", f"p{i:04d}", "New", copy) for i in range(600)]
    rows += [(f"r{i:04d}", f"r{i:04d}", "New", [rnd.random() + 2 for _ in range(3)]) for i in range(100)]
    coll = coll_df(spark, rows, parts=4)
    qs = q_df(spark, [(1, [0.5, 0.5, 0.5], None), (2, [0.0, 0.0, 0.0], None)])
    out = run(spark, coll, qs, top_k=5, deduplicate=False)
    assert [r[1] for r in out if r[0] == 1] == [f"c{i:04d}" for i in range(5)]
    assert [r[1] for r in out if r[0] == 2] == [f"c{i:04d}" for i in range(5)]
    spec = SearchSpec(top_k=5, deduplicate=False, filter_cols=("status",))
    n = candidates(spark, coll, qs, spec).count()
    assert n <= coll.rdd.getNumPartitions() * 2 * spec.fetch_k


def test_ids_that_look_like_windows_are_chunks_of_their_own(spark):
    coll = coll_df(spark, [("a", "1", "New", [0.1]), ("a_part_1", "2", "New", [0.2]), ("b", "3", "New", [0.3])])
    assert [r[1] for r in run(spark, coll, q_df(spark, [(1, [0.0], None)]), top_k=3)] == ["a", "a_part_1", "b"]


def test_sweep_equals_separate_searches(spark):
    from issuelens.operators import evaluate as Q
    from issuelens.operators.search import fetch_window

    rnd = random.Random(21)
    rows = [(f"c{i:03d}", f"p{rnd.randint(0, 40)}", "New", [rnd.gauss(0, 1) for _ in range(5)]) for i in range(300)]
    qs = q_df(spark, [(q, [rnd.gauss(0, 1) for _ in range(5)], None) for q in range(12)])
    coll = coll_df(spark, rows, parts=3)
    ks, gates = [1, 3, 5], [None, 6.0]
    cand = fetch_window(spark, coll, qs, SearchSpec(top_k=max(ks), fallback=False, filter_cols=("status",)))
    swept = {(r.k, r.threshold, r.question_id, r.id) for r in Q.sweep(cand, ks, gates).collect()}
    want = set()
    for k in ks:
        for t in gates:
            for r in run(spark, coll, qs, top_k=k, score_threshold=t):
                want.add((k, t, r[0], r[1]))
    assert swept == want


def test_windows_of_a_long_text_take_one_place(spark):
    from issuelens.operators.search import fetch_window

    # 40 windows of one text are nearest; fetch_k is 20
    rows = [("issue_1" + (f"_part_{i}" if i else ""), "1", "New", [0.01 * (i + 1)], "issue_1") for i in range(40)]
    rows += [(f"issue_{n}", str(n), "New", [float(n)], f"issue_{n}") for n in range(2, 9)]

    def coll_df(spark, rows, parts):
        df = spark.createDataFrame(rows, "id string, parent string, status string, embedding array<double>, chunk_id string")
        return df.repartition(parts)

    qs = q_df(spark, [(1, [0.0], None), (2, [0.0], "New"), (3, [0.0], "Nope")])
    want = [("issue_1", 1)] + [(f"issue_{n}", n) for n in range(2, 6)]
    for parts, extra in ((1, {}), (6, {"fanin": 2, "row_block": 7, "q_block": 2})):
        out = run(spark, coll_df(spark, rows, parts), qs, top_k=5, extra=extra)
        assert [(r[0], r[1], r[4]) for r in out] == [(q, i, k) for q in (1, 2, 3) for k, (i, _) in enumerate(want, 1)]
    seen = fetch_window(spark, coll_df(spark, rows, 3), qs.where("question_id = 1"),
                        SearchSpec(top_k=5, fallback=False, filter_cols=("status",))).orderBy("fetch_rank").collect()
    assert [(r.id, r.fetch_rank) for r in seen] == [(f"issue_{n}", n) for n in range(1, 9)]


def test_a_stored_collection_follows_its_table(spark, tmp_path):
    from issuelens.plans import inputs as I

    built = []

    def collection():
        return I.stored(spark, str(tmp_path), "t", ("documents",), lambda: built.append(1) or spark.read.parquet(path))

    path = str(tmp_path / "documents.parquet")
    spark.range(3).write.parquet(path)
    first = collection()
    assert first.count() == 3 and sorted(collection().inputFiles()) == sorted(first.inputFiles()) and len(built) == 1
    spark.range(3, 5).write.mode("append").parquet(path)
    assert collection().count() == 5 and len(built) == 2
    (spark.sparkContext._jvm.java.io.File(first.inputFiles()[0].removeprefix("file:")).getParentFile()
     .toPath().resolve("_SUCCESS").toFile().delete())
    assert collection().count() == 5 and len(built) == 2  # the other version's


def test_blocks_of_many_keys_are_passed_on_while_rows_come_in(monkeypatch):
    import pyarrow as pa

    from issuelens.operators import search as S

    monkeypatch.setattr(S, "PACK_BYTES", 1 << 20)
    taken = []

    def batches():
        for b in range(4):
            taken.append(b)
            at = range(2000 * b, 2000 * b + 2000)
            yield pa.record_batch([pa.array([str(i) if i % 4 else None for i in at]), pa.array([f"c{i:05}" for i in at]),
                                   pa.array([[float(i)] for i in at])], names=["c_k", "ids", "vec"])

    out, seen = S._packer(["c_k"], ["ids"], "ids", 300)(batches()), {}
    for n, block in enumerate(out):
        if not n:
            assert taken == [0]  # a row held as a table of its own takes more than its values
        ids, vecs = block.column("ids")[0].as_py(), block.column("vecs")[0].as_py()
        assert ids == sorted(ids) and [f"c{int(v):05}" for v in vecs] == ids and len(ids) <= 300
        seen.update((i, block.column("c_k")[0].as_py()) for i in ids)
    assert seen == {f"c{i:05}": str(i) if i % 4 else None for i in range(8000)}
