import json
import uuid


from issuelens.session import scratch_path
from issuelens.sources import issues as SI
from issuelens.sources import questions as SQ
from issuelens.sources import state as SS
from tests.conftest import base_issue, journal


def _local(spark, name):
    root = scratch_path(spark, f"test-src/{name}-{uuid.uuid4().hex}")
    import os
    os.makedirs(root, exist_ok=True)
    return root


def test_project_files_absent_and_tagged(spark):
    root = _local(spark, "raw")
    with open(f"{root}/qam.json", "w") as fh:
        json.dump([base_issue(id=5, project_identifier=None), base_issue(id=3, project_identifier=None,
                   journals=[journal(1, "B", 2, "n")])], fh)
    df = SI.read_project_files(spark, root, ["qam", "absent"])
    rows = sorted((r.id, r.project_identifier, r.seq.project_rank) for r in df.collect())
    assert rows == [(3, "qam", 0), (5, "qam", 0)]
    assert [r.id for r in SI.full_scan(df, "qam").collect()] == [3, 5]
    assert SI.read_project_files(spark, root, ["absent"]).count() == 0


def test_versioned_issue_writes(spark, make_issues):
    root = scratch_path(spark, f"test-src/master-{uuid.uuid4().hex}")
    SI.write_issues(make_issues([base_issue(id=1), base_issue(id=2, project_identifier="qam")]), root)
    cur = SI.read_issues(spark, root, ["qam"])
    SI.write_issues(cur, root)  # read and write the same table in one run
    assert [r.id for r in SI.read_issues(spark, root).collect()] == [2]


def test_question_files(spark):
    root = _local(spark, "q")
    with open(f"{root}/q.txt", "w") as fh:
        fh.write("first?\n\n# comment\n  # not a comment\n   \nlast  \n")
    got = [r.question for r in SQ.read_question_lines(spark, f"{root}/q.txt").orderBy("question_id").collect()]
    assert got == ["first?", "# not a comment", "last"]
    with open(f"{root}/q.jsonl", "w") as fh:
        fh.write('# header\n\n{"question": "a", "expected_ids": [], "tags": ["t"]}\n'
                 '  # indented comment\n{broken\n{"question": "b"}\n')
    good, bad = SQ.read_question_jsonl(spark, f"{root}/q.jsonl")
    assert sorted((r.question, r.tags) for r in good.collect()) == [("a", ["t"]), ("b", [])]
    assert bad.count() == 1


def test_state_defaults_and_corrupt(spark):
    root = _local(spark, "state")
    with open(f"{root}/a_sync.json", "w") as fh:
        json.dump({"last_synced_at": "2024-01-01T00:00:00Z", "sync_count": 2}, fh)
    with open(f"{root}/b_sync.json", "w") as fh:
        fh.write("{not json")
    with open(f"{root}/c_checkpoint.json", "w") as fh:
        json.dump({"offset": 10, "total": 2, "successful_ids": [1, 2, 3]}, fh)
    got = {r.project_id: (r.last_synced_at, r.sync_count)
           for r in SS.load_sync_state(spark, root, ["a", "b", "x"]).collect()}
    assert got == {"a": ("2024-01-01T00:00:00Z", 2), "b": (None, 0), "x": (None, 0)}
    cp = SS.load_checkpoints(spark, root, ["c", "d"])
    got = {r.project_id: (r.offset, r.total, list(r.successful_ids), r.failed_ids) for r in cp.collect()}
    assert got == {"c": (10, 2, [1, 2, 3], {}), "d": (0, None, [], {})}
    assert {r.project_id: r.complete for r in SS.is_complete(cp).collect()} == {"c": True, "d": None}


def test_saved_state_is_read_back(spark):
    root = _local(spark, "saved")
    first = spark.createDataFrame([("a", "2024-01-01T00:00:00Z", 1)], "project_id string, last_synced_at string, sync_count int")
    SS.save_sync_state(first, root)
    load = lambda: {r.project_id: (r.last_synced_at, r.sync_count)
                    for r in SS.load_sync_state(spark, root, ["a", "b"]).collect()}
    assert load() == {"a": ("2024-01-01T00:00:00Z", 1), "b": (None, 0)}
    SS.save_sync_state(first.selectExpr("project_id", "'2024-02-02T00:00:00Z' as last_synced_at", "sync_count + 1 as sync_count"), root)
    assert load()["a"] == ("2024-02-02T00:00:00Z", 2)


def test_result_sinks(spark):
    from pyspark.sql import functions as F

    from issuelens.operators.answer import numbered_results

    root = scratch_path(spark, f"test-sinks/{uuid.uuid4().hex}")
    answers = spark.createDataFrame([(2, "why?", "because"), (1, "what?", "that")],
                                    "question_id bigint, question string, answer string")
    SQ.write_numbered(numbered_results(answers), f"{root}/numbered")
    text = "".join(r.value + "\n" for r in spark.read.text(f"{root}/numbered").collect())
    assert text.index("=== Q1/2: what? ===") < text.index("=== Q2/2: why? ===")
    SQ.write_eval_results(answers.withColumn("hit", F.lit(None).cast("boolean")), f"{root}/eval")
    assert spark.read.json(f"{root}/eval").count() == 2
    mapping = spark.createDataFrame([(10, "Ines", "User_00010")], "user_id bigint, original_name string, anonymous_name string")
    SI.write_user_mapping(mapping, f"{root}/mapping")
    assert spark.read.parquet(f"{root}/mapping").first().anonymous_name == "User_00010"


def test_large_project_files_are_split_by_bytes(spark):
    root = _local(spark, "split")
    tricky = 'a quote \\" and } ] , { brackets\n  },\n  {\n and é 𝔘 \\ end'
    issues = [base_issue(id=i, project_identifier=None, subject=f"s{i}", description=tricky * (i % 5) + "x" * (i % 700),
                         journals=[journal(1, "B", 2, tricky)] if i % 3 else []) for i in range(3000)]
    for name, indent, rows in (("qam", 2, issues), ("net", None, issues[:20]), ("one", 2, issues[:1]), ("none", 2, [])):
        with open(f"{root}/{name}.json", "w", encoding="utf-8") as fh:
            json.dump(rows, fh, ensure_ascii=False, indent=indent)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = SI.read_project_files(spark, root, ["one", "qam"])
        assert df.rdd.getNumPartitions() > 10
        got = df.orderBy("seq").collect()
        assert [r.id for r in got] == [0, *range(3000)] and got[0].seq.project_rank == 0
        assert {r.project_identifier for r in got[1:]} == {"qam"}
        for r, want in zip(got[1:], issues):
            assert (r.subject, r.description, len(r.journals)) == (want["subject"], want["description"], len(want["journals"]))
            assert not r.journals or r.journals[0].notes == tricky
        both = SI.read_project_files(spark, root, ["net", "qam", "none"])
        assert both.count() == 3020 and [r.id for r in both.orderBy("seq").limit(20).collect()] == list(range(20))
        assert SI.read_project_files(spark, root, ["none"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
