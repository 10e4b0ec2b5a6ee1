import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.operators import merge as M
from issuelens.operators.collection import COLLECTION_SCHEMA, Collection
from issuelens.operators.tables import BucketTable, file_system, without
from issuelens.session import scratch_path
from tests.conftest import base_issue, journal


def rows(spark, data):
    return spark.createDataFrame(data, "id bigint, subject string, updated_on string, seq bigint")


@pytest.mark.parametrize("existing,incoming,want", [
    ([1], [2], (1, 0)),
    ([1], [1], (0, 1)),
    ([1, 2], [2, 3], (1, 1)),
    ([1], [], (0, 0)),
    ([], [1, 2, 3, 4, 5], (5, 0)),
    ([], [7, 7], (1, 1)),
])
def test_merge_counts(spark, existing, incoming, want):
    ex = rows(spark, [(i, "old", "t0", k) for k, i in enumerate(existing)])
    inc = rows(spark, [(i, "new", "t1", k) for k, i in enumerate(incoming)])
    r = M.merge_counts(ex, inc).first()
    assert (r.n_new, r.n_updated) == want


def test_merge_upsert_last_incoming_wins(spark):
    ex = rows(spark, [(1, "a", "t0", 0), (2, "b", "t0", 1)])
    inc = rows(spark, [(2, "b1", "t1", 0), (3, "c", "t1", 1), (2, "b2", "t2", 2)])
    got = sorted((r.id, r.subject) for r in M.merge_upsert(ex, inc).collect())
    assert got == [(1, "a"), (2, "b2"), (3, "c")]


def test_dedup_last_value_first_position(spark):
    df = rows(spark, [(1, "a", "t", 0), (2, "b", "t", 1), (1, "a2", "t", 2)])
    got = sorted((r.id, r.subject, r.first_seq) for r in M.dedup_last(df).collect())
    assert got == [(1, "a2", 0), (2, "b", 1)]


def test_changed_since_inclusive_and_garbage(spark):
    df = spark.createDataFrame([(1, "2024-01-15 00:00:00"), (2, "2024-01-14 23:59:59")], "id bigint, t string") \
        .withColumn("updated_ts", F.to_timestamp("t"))
    assert [r.id for r in M.changed_since(df, "2024-01-15").collect()] == [1]
    assert [r.id for r in M.changed_since(df, "2024-01-14T23:59:59").collect()] == [1, 2]
    assert M.changed_since(df, "not a date").count() == 0


def test_sync_state_resolve_and_advance(spark):
    st = spark.createDataFrame([("a", "2024-01-02T00:00:00Z", 1), ("b", None, 0), ("c", "2024-01-01T00:00:00Z", 3)],
                               "project_id string, last_synced_at string, sync_count int")
    assert M.resolve_since_value(st, ["a", "b"]) == "2024-01-02T00:00:00Z"
    assert M.resolve_since_value(st, ["a", "c"]) == "2024-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        M.resolve_since_value(st, ["b"])
    synced = spark.createDataFrame([("a",), ("new",)], "project_id string")
    got = {r.project_id: (r.last_synced_at, r.sync_count)
           for r in M.advance_sync_state(st, synced, "2024-02-01T00:00:00Z").collect()}
    assert got == {"a": ("2024-02-01T00:00:00Z", 2), "new": ("2024-02-01T00:00:00Z", 1),
                   "b": (None, 0), "c": ("2024-01-01T00:00:00Z", 3)}


def test_journals_filters_and_overlay(make_issues):
    iss = make_issues([base_issue(id=1, project_identifier="openqatests"),
                       base_issue(id=2, project_identifier="openqatests", journals=[journal(1, "B", 2, "n")]),
                       base_issue(id=3, project_identifier="qam", journals=None)])
    assert sorted(r.id for r in M.journals_only(iss).collect()) == [2, 3]
    assert sorted(r.id for r in M.missing_journals(iss).collect()) == [1, 3]
    full = make_issues([base_issue(id=3, subject="fetched", journals=[journal(1, "B", 2, "n")])])
    got = {r.id: r.subject for r in M.enrich_overlay(iss, full).collect()}
    assert got == {1: "Cache fills the disk", 2: "Cache fills the disk", 3: "fetched"}
    cov = M.journal_coverage(iss).first()
    assert (cov.with_journals, cov.total) == (1, 3)


def test_resume_and_completeness(spark):
    cand = spark.createDataFrame([(i,) for i in range(5)], "id bigint")
    done = spark.createDataFrame([(0, "p"), (1, "p"), (1, "p")], "id bigint, project_id string")
    assert sorted(r.id for r in M.resume_pending(cand, done).collect()) == [2, 3, 4]
    totals = spark.createDataFrame([("p", 2), ("q", 0)], "project_id string, total bigint")
    got = {r.project_id: r.complete for r in M.completeness(done, totals).collect()}
    assert got == {"p": True, "q": True}  # done >= total, not ==


def _chunks(spark, ids, text):
    data = [(i, text, i, *[""] * 10, 0, 0, True, i, 0, [0.0, 1.0], "m") for i in ids]
    return spark.createDataFrame(data, COLLECTION_SCHEMA)


def test_collection_upsert_and_reset(spark):
    c = Collection(spark, scratch_path(spark, f"test/{uuid.uuid4().hex}"), "issues").get_or_create()
    assert c.count() == 0
    assert c.upsert(_chunks(spark, [], "x")) is None
    c.upsert(_chunks(spark, ["a", "b"], "v1"))
    c.upsert(_chunks(spark, ["b", "c"], "v2"))
    got = sorted((r.id, r.text) for r in c.read().collect())
    assert got == [("a", "v1"), ("b", "v2"), ("c", "v2")]
    c.reset()
    assert c.count() == 0


def test_journals_only_not_applied_on_sync(make_issues):
    iss = make_issues([base_issue(id=1, project_identifier="openqatests")])
    assert M.journals_only(iss).count() == 0
    assert M.journals_only(iss, mode="incremental").count() == 1


def _sizes(c):
    """Bytes and modification time of each data file."""
    import glob
    import os
    return {f: (os.path.getsize(f), os.stat(f).st_mtime_ns) for f in glob.glob(f"{c.path}/rows/**/part-*.parquet", recursive=True)}


def test_an_upsert_rewrites_the_buckets_it_touches(spark):
    c = Collection(spark, scratch_path(spark, f"test/{uuid.uuid4().hex}"), "issues", buckets=32).get_or_create()
    c.upsert(_chunks(spark, [f"c{i}" for i in range(2000)], "v1"))
    before = _sizes(c)
    assert len(c.upsert(_chunks(spark, ["c7", "c8"], "v2"))) <= 2
    after = _sizes(c)
    written = sum(size for f, (size, at) in after.items() if before.get(f) != (size, at))
    assert 0 < written < 0.15 * sum(size for size, _ in after.values())
    assert {r.id for r in c.read().where("text = 'v2'").collect()} == {"c7", "c8"} and c.count() == 2000


def test_a_partition_that_lost_its_rows_goes(spark):
    c = Collection(spark, scratch_path(spark, f"test/{uuid.uuid4().hex}"), "issues", buckets=2).get_or_create()
    rows = _chunks(spark, ["a", "b", "c", "d"], "v1")
    c.upsert(rows.withColumn("project_id", F.lit("old place/ 1%")))
    c.upsert(rows.withColumn("project_id", F.lit("new")).where("id <> 'd'"))
    assert sorted((r.id, r.project_id) for r in c.read().collect()) == [
        ("a", "new"), ("b", "new"), ("c", "new"), ("d", "old place/ 1%")]
    c.upsert(rows.where("id = 'd'"))  # no project at all
    assert sorted((r.id, r.project_id) for r in c.read().collect()) == [("a", "new"), ("b", "new"), ("c", "new"), ("d", "")]


def test_a_lost_upsert_is_finished_or_dropped(spark, monkeypatch):
    c = Collection(spark, scratch_path(spark, f"test/{uuid.uuid4().hex}"), "issues", buckets=4).get_or_create()
    c.upsert(_chunks(spark, ["a", "b"], "v1"))
    with monkeypatch.context() as m:  # the driver dies after the new content is complete
        m.setattr(type(c.table), "recover", lambda self: None)
        c.upsert(_chunks(spark, ["b", "c"], "v2"))
        assert sorted((r.id, r.text) for r in c.read().collect()) == [("a", "v1"), ("b", "v1")]
    c.get_or_create()
    assert sorted((r.id, r.text) for r in c.read().collect()) == [("a", "v1"), ("b", "v2"), ("c", "v2")]
    _chunks(spark, ["x"], "v3").write.parquet(c.table.staged)
    c.table._delete(f"{c.table.staged}/_SUCCESS")  # and before it is
    c.get_or_create()
    assert sorted(r.id for r in c.read().collect()) == ["a", "b", "c"]


def test_expire_keeps_the_newest_versions(spark):
    from issuelens.operators.tables import expire, versions

    root = scratch_path(spark, f"test/{uuid.uuid4().hex}")
    for v in range(4):
        spark.range(1).write.parquet(f"{root}/v={v}")
    expire(spark, root)
    assert versions(spark, root) == [2, 3]


def test_changed_since_accepts_sync_state_format(spark):
    df = spark.createDataFrame([(1, "2024-01-15 10:00:00"), (2, "2024-01-15 09:59:59")], "id bigint, t string") \
        .withColumn("updated_ts", F.to_timestamp("t"))
    assert [r.id for r in M.changed_since(df, "2024-01-15T10:00:00Z").collect()] == [1]


def test_upsert_prune_stale_chunks(spark):
    from issuelens.operators.collection import COLLECTION_SCHEMA

    def chunks(rows):
        return spark.createDataFrame([(i, t, iss, *[""] * 10, 0, 0, True, i, 0, [0.0], "m") for i, t, iss in rows],
                                     COLLECTION_SCHEMA)

    c = Collection(spark, scratch_path(spark, f"test/{uuid.uuid4().hex}"), "issues").get_or_create()
    c.upsert(chunks([("issue_1", "a", "1"), ("issue_1_chunk_1", "b", "1"), ("issue_2", "c", "2")]))
    # issue 1 lost its journals: default upsert keeps the stale chunk, prune removes it
    c.upsert(chunks([("issue_1", "a2", "1")]))
    assert sorted(r.id for r in c.read().collect()) == ["issue_1", "issue_1_chunk_1", "issue_2"]
    c.upsert(chunks([("issue_1", "a3", "1")]), prune_stale=True)
    assert sorted((r.id, r.text) for r in c.read().collect()) == [("issue_1", "a3"), ("issue_2", "c")]


def _files(spark, root):
    fs, p = file_system(spark, root)
    found, out = fs.listFiles(p, True) if fs.exists(p) else None, set()
    while found is not None and found.hasNext():
        name = found.next().getPath().getName()
        if name.endswith(".parquet"):
            out.add(name)
    return out


def _issue_table(spark):
    return BucketTable(spark, scratch_path(spark, f"renamed/{uuid.uuid4().hex}"),
                       T.StructType.fromDDL("id bigint, p string, v string"), "id", 4, ("p",))


def _replace(here, new):
    return without(here, new, "id").unionByName(new)


def test_staged_partitions_are_renamed_not_copied(spark, monkeypatch):
    t, staged = _issue_table(spark), set()
    recover = BucketTable.recover
    monkeypatch.setattr(BucketTable, "recover", lambda self: (staged.update(_files(spark, self.staged)), recover(self)))
    for v, moved in (("a", 0), ("b", 1)):
        staged.clear()
        t.upsert(spark.createDataFrame([(i, "x: 1%" if (i + moved) % 3 else None, v) for i in range(40)], t.schema), _replace)
        assert staged and staged <= _files(spark, t.rows)
        got = {r.id: (r.p, r.v) for r in t.read().collect()}
        assert got == {i: ("x: 1%" if (i + moved) % 3 else "", v) for i in range(40)} and t.read().count() == 40


def test_a_replacement_lost_between_two_partitions_is_finished(spark, monkeypatch):
    t = _issue_table(spark)
    t.upsert(spark.createDataFrame([(i, f"p{i % 3}", "a") for i in range(60)], t.schema), _replace)
    real = BucketTable._partitions

    class Lost(dict):
        def items(self):
            yield from list(super().items())[:4]
            raise InterruptedError

    def partitions(self, root, bucket):
        found = real(self, root, bucket)
        return Lost(found) if root == self.staged and self._exists(f"{self.staged}/_swept") else found

    monkeypatch.setattr(BucketTable, "_partitions", partitions)
    moved = spark.createDataFrame([(i, f"p{(i + 1) % 2}", "b") for i in range(0, 60, 2)], t.schema)
    with pytest.raises(InterruptedError):
        t.upsert(moved, _replace)
    monkeypatch.setattr(BucketTable, "_partitions", real)
    t.recover()
    assert {r.id: (r.p, r.v) for r in t.read().collect()} == {
        i: (f"p{i % 3}", "a") if i % 2 else (f"p{(i + 1) % 2}", "b") for i in range(60)}
    assert t.read().count() == 60
