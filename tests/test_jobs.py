import uuid

import pytest

from issuelens.config import EngineConfig
from issuelens.operators.embed import HashEmbedder
from issuelens.plans import jobs as J
from issuelens.session import scratch_path
from issuelens.sources import state as SS
from tests.conftest import base_issue, journal
from tests.test_merge_state import _sizes

EMBED = HashEmbedder(8)


def config(spark, **kw):
    return EngineConfig(base_path=scratch_path(spark, f"job/{uuid.uuid4().hex}"),
                        **{"project_ids": ("storage", "net"), "journals_only_projects": ("net",), **kw})


def issue(i, text, updated, **kw):
    return base_issue(id=i, subject=text, updated_on=updated, **kw)


@pytest.mark.parametrize("turn", [1, -1])
def test_of_two_versions_the_later_update_is_stored(spark, make_issues, turn):
    rows = [issue(1, "old", "2024-01-01T10:00:00Z"), issue(1, "new", "2024-01-02T09:00:00Z"), issue(2, "x", None)]
    cfg = config(spark)
    coll = J.ingest(spark, cfg, J.fetch(spark, cfg, make_issues(rows[::turn]), full=True), EMBED, "2024-02-01T00:00:00Z")
    assert {r.id: r.subject for r in J.issue_store(spark, cfg).read().collect()} == {1: "new", 2: "x"}
    assert {r.issue_id: r.subject for r in coll.read().collect()} == {"1": "new", "2": "x"}


def test_of_equal_updates_the_last_position_is_stored(spark, make_issues):
    rows = [issue(1, "a", "2024-01-01T10:00:00Z") for _ in range(11)] + [issue(1, "last", "2024-01-01T10:00:00Z")]
    assert [r.subject for r in J.fetch(spark, config(spark), make_issues(rows), full=True).collect()] == ["last"]


def test_full_load_enriches_then_drops_what_has_no_journals(spark, make_issues):
    listed = make_issues([issue(1, "a", None, project_identifier="net"), issue(2, "b", None, project_identifier="net"),
                          issue(3, "c", None, journals=[journal(1, "B", 2, "kept")]), issue(4, "d", None),
                          issue(5, "e", None, project_identifier="other")])
    details = make_issues([issue(1, "A", None, project_identifier="net", journals=[journal(1, "B", 2, "n")]),
                           issue(3, "C", None), issue(9, "Z", None)])
    got = {r.id: r.subject for r in J.fetch(spark, config(spark), listed, full=True, details=details).collect()}
    assert got == {1: "A", 3: "c", 4: "d"}  # 3 has journals already; 2 has none in a journals-only project


def test_incremental_run_starts_where_the_last_one_began(spark, make_issues):
    cfg = config(spark)
    with pytest.raises(ValueError):
        J.fetch(spark, cfg, make_issues([issue(1, "a", None)]))
    J.ingest(spark, cfg, J.fetch(spark, cfg, make_issues([issue(1, "a", "2024-01-01T00:00:00Z"),
             issue(2, "n", "2024-01-01T00:00:00Z", project_identifier="net", journals=[journal(1, "B", 2, "n")])]),
             full=True), EMBED, "2024-01-05T00:00:00Z")
    later = make_issues([issue(1, "late", "2024-01-04T23:59:59Z"), issue(2, "same second", "2024-01-05T00:00:00Z",
                         project_identifier="net")])
    assert {r.id: r.subject for r in J.fetch(spark, cfg, later).collect()} == {2: "same second"}
    assert {r.id for r in J.fetch(spark, cfg, later, since="2024-01-01").collect()} == {1, 2}
    J.ingest(spark, cfg, J.fetch(spark, cfg, later), EMBED, "2024-01-09T00:00:00Z")
    state = {r.project_id: (r.last_synced_at, r.sync_count) for r in SS.load_sync_state(
        spark, cfg.state_dir, cfg.project_ids).collect()}
    assert state == {"storage": ("2024-01-05T00:00:00Z", 1), "net": ("2024-01-09T00:00:00Z", 2)}
    assert {r.id for r in J.issue_store(spark, cfg).read().collect()} == {1, 2}


def test_second_run_writes_a_share_of_the_bytes(spark, make_issues):
    cfg = config(spark)
    rows = [issue(i, f"subject {i}", "2024-01-01T00:00:00Z", description="words " * 50) for i in range(400)]
    coll = J.ingest(spark, cfg, J.fetch(spark, cfg, make_issues(rows), full=True), EMBED, "2024-01-05T00:00:00Z")
    before = _sizes(coll)
    changed = make_issues([issue(3, "changed", "2024-01-06T00:00:00Z")])
    J.ingest(spark, cfg, J.fetch(spark, cfg, changed), EMBED, "2024-01-09T00:00:00Z")
    after = _sizes(coll)
    written = sum(size for f, (size, at) in after.items() if before.get(f) != (size, at))
    assert 0 < written < 0.3 * sum(size for size, _ in after.values())
    assert coll.count() == 400 and [r.text for r in coll.read().where("issue_id = '3'").collect()][0].startswith("Subject: changed")


def test_run_log_counts_in_the_writes_and_merges_users(spark, make_issues):
    from issuelens.operators import runlog as L

    cfg = config(spark)
    person = lambda k: {"id": k, "name": f"U{k}"}
    for run in range(3):  # runs share a third of their users
        rows = [issue(i, "s", f"2024-0{run + 1}-02T00:00:00Z", author=person(1000 * run + i), watchers=[person(500_000 + i)],
                      description="long " * 700 if i == 0 else "d",
                      journals=[journal(1, "B", 2, "n")] if i % 2 else []) for i in range(1500)]
        J.ingest(spark, cfg, J.fetch(spark, cfg, make_issues(rows), full=True), EMBED, f"2024-0{run + 1}-03T00:00:00Z")
    log = spark.read.parquet(J.run_log(cfg))
    for r in log.collect():
        assert (r.issues, r.with_journals, r.chunked_issues, r.chunks, r.windows) == (1500, 750, 1500, 2250, 2252)
    got = L.users_of_runs(log).first()
    exact = len({1000 * run + i for run in range(3) for i in range(1500)} | {500_000 + i for i in range(1500)} | {2})
    assert got.runs == 3 and abs(got.users - exact) < 3 * 1.04 / 2 ** (L.SKETCH_BITS / 2) * exact
    assert L.users_of_runs(log.limit(0)).first().users == 0


@pytest.mark.parametrize("repeated", [False, True])
def test_issues_of_distinct_ids_are_not_stored_beside_the_tables(spark, make_issues, monkeypatch, repeated):
    from issuelens.operators.tables import BucketTable

    beside, recover = [], BucketTable.recover

    def watched(self):
        if self._exists(f"{self.path}/incoming"):
            beside.append(self.path)
        recover(self)

    monkeypatch.setattr(BucketTable, "recover", watched)
    cfg = config(spark)
    rows = [issue(i, "s", "2024-01-02T00:00:00Z", description="long " * 700, journals=[journal(1, "B", 2, "n")]) for i in range(1, 7)]
    coll = J.ingest(spark, cfg, make_issues(rows + rows[:repeated]), EMBED, "2024-01-03T00:00:00Z")
    J.ingest(spark, cfg, make_issues([issue(1, "new", "2024-01-04T00:00:00Z")]), EMBED, "2024-01-05T00:00:00Z")
    assert bool(beside) == repeated
    ids = [r.id for r in coll.read().collect()]
    assert sorted(ids) == sorted(set(ids)) and len(ids) == 1 + 5 * 4
    assert [r.subject for r in coll.read().where("issue_id = '1'").collect()] == ["new"]
    log = {r.started_at: r for r in spark.read.parquet(J.run_log(cfg)).collect()}
    first = log["2024-01-03T00:00:00Z"]
    assert (first.issues, first.chunked_issues, first.chunks, first.windows) == (
        6 + repeated, 6 + repeated, 12 + 2 * repeated, 24 + 4 * repeated)
