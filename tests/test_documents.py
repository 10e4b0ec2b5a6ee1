import random

import pytest
from pyspark.sql import functions as F

from issuelens.operators import documents as D
from tests.conftest import base_issue, journal


def chunk_rows(df, per=5, max_len=4000):
    return [(r.id, r.text, r.chunk_index, r.is_description)
            for r in D.prepare_chunks(df, per, max_len).orderBy("chunk_index").collect()]


def test_six_journals_five_per_chunk(make_issues):
    iss = base_issue(journals=[journal(i, "Bob", 20, f"Journal entry number {i}.") for i in range(1, 7)])
    rows = chunk_rows(make_issues([iss]))
    head = "Subject: Cache fills the disk"
    assert rows == [
        ("issue_1", f"{head}\nDescription: It grows every night", 0, True),
        ("issue_1_chunk_1", f"{head}\nComments:\n- Bob: Journal entry number 1.\n- Bob: Journal entry number 2.\n"
         "- Bob: Journal entry number 3.\n- Bob: Journal entry number 4.\n- Bob: Journal entry number 5.", 1, False),
        ("issue_1_chunk_2", f"{head}\nComments:\n- Bob: Journal entry number 6.", 2, False)]


def test_ten_journals_three_per_chunk(make_issues):
    iss = base_issue(journals=[journal(i, "Bob", 20, f"Journal entry number {i}.") for i in range(1, 11)])
    assert len(chunk_rows(make_issues([iss]), per=3)) == 5


def test_empty_and_null_notes_skipped(make_issues):
    iss = base_issue(journals=[journal(1, "Bob", 20, "real"), journal(2, "Bob", 20, ""),
                               {"id": 3, "user": None, "notes": None, "created_on": None}])
    rows = chunk_rows(make_issues([iss]))
    assert len(rows) == 2 and rows[1][1].count("\n- ") == 1


def test_empty_issue_gives_one_chunk(make_issues):
    rows = chunk_rows(make_issues([{}]))
    assert rows == [("issue_", "Subject:", 0, True)]


def test_id_only_metadata_blank(make_issues):
    meta = make_issues([{"id": 99}]).select(*D.metadata_columns()).first().asDict()
    assert meta["issue_id"] == "99" and meta["num_journals"] == 0
    assert all(meta[k] == "" for k in meta if k not in ("issue_id", "num_journals"))


def test_subject_metadata_capped(make_issues):
    meta = make_issues([base_issue(subject="s" * 600)]).select(*D.metadata_columns()).first()
    assert len(meta.subject) == 500


def test_user_without_name_is_unknown(make_issues):
    iss = base_issue(journals=[{"id": 1, "user": None, "notes": "hello", "created_on": None}])
    rows = chunk_rows(make_issues([iss]))
    assert "- Unknown: hello" in rows[1][1]


def test_prepare_single_document(make_issues):
    iss = base_issue(journals=[journal(1, "Bob", 20, "first"), journal(2, "Carol", 21, "second")])
    r = D.prepare(make_issues([iss])).first()
    assert r.id == "issue_1"
    assert r.text == ("Subject: Cache fills the disk\nDescription: It grows every night\nComments:\n"
                      "- Bob: first\n- Carol: second")


def test_random_issues_keep_every_note_once_and_in_order(make_issues):
    rnd = random.Random(7)
    issues, notes = [], {}
    for i in range(1, 61):
        js = []
        for k in range(rnd.randint(0, 13)):
            note = rnd.choice([None, "", f"note {i}-{k} 🙂", f"β\n{i}-{k}"])
            js.append(journal(k, rnd.choice(["Bob", ""]), k, note))
            if note:
                notes.setdefault(i, []).append(note)
        issues.append(base_issue(id=i, subject=rnd.choice(["s", "", None]), description=rnd.choice(["d" * 90, "", None]), journals=js))
    by = {}
    for r in D.prepare_chunks(make_issues(issues), 3, 4000).collect():
        by.setdefault(int(r.issue_id), []).append(r)
    assert set(by) == set(range(1, 61))
    for i, rows in by.items():
        rows.sort(key=lambda r: r.chunk_index)
        assert [r.chunk_index for r in rows] == list(range(len(rows)))
        assert [r.is_description for r in rows] == [True] + [False] * (len(rows) - 1)
        assert [r.id for r in rows] == [f"issue_{i}"] + [f"issue_{i}_chunk_{k}" for k in range(1, len(rows))]
        want = notes.get(i, [])
        assert len(rows) - 1 == -(-len(want) // 3)
        for k, r in enumerate(rows[1:]):
            body = r.text.split("\nComments:\n", 1)[1]
            places = [body.index(n) for n in want[3 * k:3 * k + 3]]
            assert places == sorted(places) and body.count("- ") == len(places)


def test_long_chunks_are_cut_and_marked(make_issues):
    from issuelens import config as C

    rows = chunk_rows(make_issues([base_issue(description="d" * 500, journals=[journal(1, "Bob", 2, "n" * 500)])]), max_len=60)
    assert [len(r[1]) for r in rows] == [60 + len(C.TRUNCATION_SUFFIX)] * 2
    assert all(r[1].endswith(C.TRUNCATION_SUFFIX) for r in rows)


def test_expansion_counts(make_issues):
    iss = [base_issue(id=1, journals=[journal(k, "B", 2, "n") for k in range(7)]), base_issue(id=2)]
    c = D.expansion_counts(D.prepare_chunks(make_issues(iss))).first()
    assert (c.n_issues, c.n_chunks) == (2, 4)


def test_turn_chunks_equal_nested_chunks(spark):
    from issuelens.operators.anonymize import anonymize_issues
    from issuelens.operators.turns import conversation_chunks
    from issuelens.sources.adapters import conversation_issues

    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    # a hot conversation: many turns in one issue, spread over partitions
    hot = spark.range(1, 400).select(F.lit(777).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                     F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
                                     F.when(F.col("id") % 7 == 0, "").otherwise(
                                         F.concat(F.lit("note a@b.com "), F.col("id").cast("string"))).alias("text"))
    turns = conv.unionByName(hot).repartition(6)
    for anon in (True, False):
        nested = conversation_issues(turns)
        nested = anonymize_issues(nested) if anon else nested
        want = sorted(tuple(r) for r in D.prepare_chunks(nested, 5, 300).collect())
        got = sorted(tuple(r) for r in conversation_chunks(turns, 5, 300, anon)
                     .select(*D.prepare_chunks(nested, 5, 300).columns).collect())
        assert got == want


def test_turn_documents_equal_nested_prepare(spark):
    from issuelens.operators.anonymize import anonymize_issues
    from issuelens.operators.turns import conversation_documents
    from issuelens.sources.adapters import conversation_issues

    conv = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    # long conversation with blank-heavy notes around the cut
    hot = spark.range(1, 300).select(F.lit(888).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                     F.lit("user").alias("role"),
                                     F.when(F.col("id") % 5 == 0, F.lit("x" + " " * 90)).otherwise(
                                         F.concat(F.lit("n "), F.col("id").cast("string"), F.lit("   "))).alias("text"))
    turns = conv.unionByName(hot).repartition(5)
    for anon in (False, True):
        for max_len in (60, 400, 8192):
            nested = conversation_issues(turns)
            nested = anonymize_issues(nested) if anon else nested
            want = sorted((r.id, r.text, r.num_journals) for r in D.prepare(nested, max_len).collect())
            got = sorted((r.id, r.text, r.num_journals)
                         for r in conversation_documents(turns, max_len, anon).collect())
            assert got == want


def test_turn_renderings_hold_every_turn_in_order(spark):
    from issuelens.operators.turns import conversation_journal_text, conversation_user_lists

    hot = spark.range(1, 2600).select(F.lit(999).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                      F.when(F.col("id") % 4 == 0, "system").otherwise("user").alias("role"),
                                      F.when(F.col("id") % 9 == 0, "").otherwise(
                                          F.concat(F.lit("note "), F.col("id").cast("string"))).alias("text"))
    text = conversation_journal_text(hot.repartition(5)).first().comments
    assert [int(x.rsplit(" ", 1)[1]) for x in text.split("\n")] == [i for i in range(2, 2600) if i % 9]
    lists = conversation_user_lists(hot.repartition(5)).first()
    assert lists.notes.split("\n") == ["" if i % 9 == 0 else f"note {i}" for i in range(2, 2600)]
    assert len(lists.journal_users.split(",")) == 2598


def test_blank_runs_do_not_move_the_cut(spark):
    from issuelens.operators.turns import conversation_documents

    turns = spark.createDataFrame([(1, 0, "user", "s"), (1, 1, "user", "x" + " " * 9000), (1, 2, "user", "end")],
                                  "conv_id long, turn long, role string, text string")
    text = conversation_documents(turns, 8192).first().text
    assert text.startswith("Subject: s") and len(text) > 8192


@pytest.mark.parametrize("partitions", ["8", "200"])
def test_numbering_keeps_every_row_of_a_hot_key(spark, partitions):
    from issuelens.operators.ordering import with_index, with_key_rank, with_key_running_sum

    n = 1_000_000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spark.range(n).select(
            F.when(F.col("id") % 5 < 4, 7).otherwise(F.col("id") % 1000).alias("k"),
            F.xxhash64("id").alias("at"), F.lit(1).alias("one"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        hot = F.col("k") == 7
        size = rows.where(hot).count()
        ranked = with_key_rank(rows, "k", ["at"], "r")
        assert ranked.agg(F.count("*"), F.countDistinct("wide")).first()[:] == (n, n)
        assert ranked.where(hot).agg(F.min("r"), F.max("r"), F.countDistinct("r")).first()[:] == (1, size, size)
        run = with_key_running_sum(rows, "k", ["at"], "one", "r", "c")
        assert run.where("r <> c").count() == 0 and run.count() == n
        idx = with_index(rows, ["at"], "i", "n")
        assert idx.agg(F.min("i"), F.max("i"), F.countDistinct("i"), F.min("n")).first()[:] == (1, n, n, n)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
