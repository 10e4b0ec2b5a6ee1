
from issuelens.operators import evaluate as Q
from issuelens.operators import runlog as T


def test_hit_semantics(spark):
    qs = spark.createDataFrame([(1, ["1", "2"]), (2, []), (3, ["9"])], "question_id bigint, expected_ids array<string>")
    hits = spark.createDataFrame([(1, "2", 0.5), (1, "5", 0.7), (2, "3", 0.1)],
                                 "question_id bigint, issue_id string, score double")
    res = Q.per_question(qs, hits, expected=Q.expected_from_lists(qs))
    got = {r.question_id: (r.hit, r.n_results, r.best_score, r.retrieved_ids) for r in res.collect()}
    assert got == {1: (True, 2, 0.5, ["2", "5"]), 2: (None, 1, 0.1, ["3"]), 3: (False, 0, None, [])}
    labels = {r.question_id: r.l for r in res.select("question_id", Q.label().alias("l")).collect()}
    assert labels == {1: "HIT", 2: "N/A", 3: "MISS"}
    s = Q.summary(res).first()
    assert (s.total, s.evaluable, s.hits, s.not_applicable, s.hit_rate_pct) == (3, 2, 1, 1, 50.0)


def test_hit_rate_text_half_even(spark):
    df = spark.createDataFrame([(12.5,), (13.5,), (None,)], "hit_rate_pct double")
    assert [r[0] for r in df.select(Q.hit_rate_text()).collect()] == ["12%", "14%", None]


def test_stage_share_and_bar(spark):
    log = spark.createDataFrame([("r", "load", 0.3), ("r", "chunk", 0.1), ("r", "embed", 281.4), ("z", "x", 0.0)],
                                "run string, stage string, elapsed double")
    got = {(r.run, r.stage): (r.pct, r.bar) for r in T.stage_share(log, "run", "stage", "elapsed").collect()}
    assert got[("r", "embed")][1] == "#" * 19 and got[("z", "x")] == (0.0, "")


def test_rolling_eta(spark):
    log = spark.createDataFrame([(1, i, float(i)) for i in range(1, 5)], "k bigint, t bigint, d double")
    got = [r.eta for r in T.rolling_eta(log, "k", ["t"], "d", in_flight=2, window=2).orderBy("t").collect()]
    # no history -> 2 x 40.0; then means of the previous (up to) two durations
    assert got == [80.0, 2.0, 3.0, 5.0]


def test_rolling_eta_hot_key_matches_brute_force(spark):
    import random
    rnd = random.Random(2)
    rows = [(0 if i % 3 else rnd.randint(1, 5), i, round(rnd.uniform(0.01, 90), 2)) for i in range(900)]
    log = spark.createDataFrame(rows, "k bigint, t bigint, d double").repartition(5)
    got = {(r.k, r.t): (r.mean_duration, r.eta) for r in T.rolling_eta(log, "k", ["t"], "d", window=50).collect()}
    by_key = {}
    for k, t, d in sorted(rows, key=lambda x: (x[0], x[1])):
        hist = by_key.setdefault(k, [])
        prev = hist[-50:]
        if prev:
            s, n = sum(round(x * 100) for x in prev), len(prev)
            want = ((2 * s * 10000 + n) // (2 * n) / 1e6, (2 * s + 10 * n) // (20 * n) / 10.0)
        else:
            want = (40.0, 40.0)
        assert got[(k, t)] == want
        hist.append(d)


def test_cube_equals_separate_groupings(spark):
    from issuelens.operators import evaluate as Q

    judged = [(k, t, q, (q * k) % 3 == 0) for k in (1, 5) for t in (None, 1.0) for q in range(10) if t is None or q % 2]
    tags = [(q, tag) for q in range(10) for tag in (["a"] if q < 4 else ["b", "c"])]
    df = spark.createDataFrame(judged, "k int, threshold double, question_id long, hit boolean")
    got = {(r.level, r.tag, r.k, r.threshold): (r.answered, r.hits) for r in Q.cube(
        df, spark.createDataFrame(tags, "question_id long, tag string")).collect()}
    rows = [(tag, k, t, h) for k, t, q, h in judged for q2, tag in tags if q == q2]
    want = {}
    for tag, k, t, h in rows:
        for key in ((0, tag, k, t), (4, None, k, t), (3, tag, None, None), (7, None, None, None)):
            n, hits = want.get(key, (0, 0))
            want[key] = (n + 1, hits + h)
    assert got == want


def test_records_carry_filters_and_time(spark):
    from issuelens.operators import evaluate as Q

    res = spark.createDataFrame([(1, True), (2, None), (3, False)], "question_id long, hit boolean")
    applied = spark.createDataFrame([(1, '{"status":"New"}'), (3, None)], "question_id long, filters string")
    times = spark.createDataFrame([(1, 0.25), (1, 0.5), (3, 1.0)], "question_id long, elapsed double")
    rec = Q.records(res, applied, times)
    assert {r.question_id: (r.filters, r.elapsed) for r in rec.collect()} == {
        1: ('{"status":"New"}', 0.75), 2: ("{}", 0.0), 3: ("{}", 1.0)}
    s = Q.summary(rec).first()
    assert (s.total, s.evaluable, s.hits, s.not_applicable, s.total_elapsed) == (3, 2, 1, 1, 1.75)
