import random
import uuid

import pytest

from issuelens.operators import documents as D
from issuelens.session import scratch_path
from issuelens.streaming import chunk_state as K
from issuelens.streaming import sync as S
from tests.conftest import base_issue, journal

SCHEMA = "issue_id string, is_issue boolean, subject string, body string, line string, pos long"


class _Map(dict):
    """Map state as the processor uses it, counting reads and writes."""

    reads = writes = 0

    def getValue(self, key):
        self.reads += 1
        return self[key]

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value


def keeper(per_chunk=5):
    k = K.ChunkKeeper(per_chunk)
    k.chunks = _Map()
    return k


@pytest.mark.parametrize("order", ["forward", "backward", "random"])
def test_lines_lie_in_order_whatever_the_arrival(order):
    positions = list(range(0, 94, 2))
    if order != "forward":
        positions = positions[::-1] if order == "backward" else random.Random(4).sample(positions, len(positions))
    k, n, last = keeper(), 0, -1
    for i, p in enumerate(positions):
        n, lo, hi = k._insert(n, last, p, f"l{p}")
        last = max(last, p)
        so_far = sorted(positions[:i + 1])
        assert [x for c in range(1, n + 1) for x in k.chunks[(c,)][0]] == so_far
        assert all(len(k.chunks[(c,)][0]) == 5 for c in range(1, n))
        assert lo == so_far.index(p) // 5 + 1 and hi in (lo, n)
    before = {c: list(v[1]) for c, v in k.chunks.items()}
    assert k._insert(n, last, positions[3], f"l{positions[3]}")[0] == n  # delivered again
    assert {c: list(v[1]) for c, v in k.chunks.items()} == before


def test_a_new_comment_touches_the_last_chunk_only():
    k, n = keeper(), 0
    for p in range(1000):
        n, _, _ = k._insert(n, p - 1, p, "x")
    k.chunks.reads = k.chunks.writes = 0
    assert k._insert(n, 999, 1000, "y") == (201, 201, 201)
    assert k.chunks.reads <= 1 and k.chunks.writes == 1
    k.chunks.reads = k.chunks.writes = 0
    k._insert(201, 1000, 1001, "z")
    assert k.chunks.reads == 1 and k.chunks.writes == 1


def test_stream_equals_batch_over_late_parts(spark, make_issues):
    rnd = random.Random(8)
    issues, updates = [], []
    for i in range(1, 9):
        notes = [rnd.choice(["", None, f"note {i} {j}", "long " * 300]) for j in range(rnd.choice([0, 1, 5, 6, 23]))]
        subject, text = f"Subject {i}", rnd.choice([None, "", f"text of {i}"])
        issues.append(base_issue(id=i, subject=subject, description=text,
                                 journals=[journal(j, f"U{j}", j, x) for j, x in enumerate(notes)]))
        updates.append((str(i), True, subject, text, None, 0))
        updates += [(str(i), False, subject, None, f"- U{j}: {x}" if x else None, j + 1) for j, x in enumerate(notes)]
    rnd.shuffle(updates)
    want = {r.id: r.text for r in D.prepare_chunks(make_issues(issues), 5, 400).collect()}
    root = scratch_path(spark, f"test-state/{uuid.uuid4().hex}")
    third = len(updates) // 3
    for n, part in enumerate((updates[:third], updates[third:2 * third], updates[2 * third:] + updates[:9])):
        spark.createDataFrame(part, SCHEMA).write.parquet(f"{root}/in/part={n}")
        stream = S.file_stream(spark, f"{root}/in/*", spark.createDataFrame([], SCHEMA).schema)
        table = K.run_chunk_stream(stream, f"{root}/table", f"{root}/_c", partitions=2, max_text_len=400)
    assert {r.id: r.text for r in table.collect()} == want


def test_a_new_subject_rewrites_all_chunks(spark):
    root = scratch_path(spark, f"test-subject/{uuid.uuid4().hex}")
    parts = ([("1", True, "old", "d", None, 0), *(("1", False, "old", None, f"l{p}", p) for p in range(1, 8))],
             [("1", False, "new", None, "l8", 8)], [("1", False, "late", None, "l", 3)])
    for n, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).write.parquet(f"{root}/in/part={n}")
        stream = S.file_stream(spark, f"{root}/in/*", spark.createDataFrame([], SCHEMA).schema)
        table = K.run_chunk_stream(stream, f"{root}/table", f"{root}/_c", partitions=2)
    assert {r.id: r.text for r in table.collect()} == {
        "issue_1": "Subject: new\nDescription: d",
        "issue_1_chunk_1": "Subject: new\nComments:\nl1\nl2\nl\nl4\nl5",
        "issue_1_chunk_2": "Subject: new\nComments:\nl6\nl7\nl8"}
