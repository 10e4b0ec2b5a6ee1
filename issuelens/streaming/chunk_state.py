"""Chunks of a stream of issue updates, kept up to date per issue (X2 with D5 and D6).

``transformWithState`` keeps of each issue its comment lines, a few to a
chunk, in map state by chunk number.  A new comment reads and writes the last
chunk only.  A comment that comes late goes where its position belongs: its
chunk is found by bisection and its overflow is carried through the chunks
behind, one at a time, so a task holds two chunks of an issue however long it
is.  What leaves are the chunks that changed, and the table takes them in by id.

Updates: ``issue_id, is_issue, subject, body, line, pos``.  A row with
``is_issue`` brings the description (body); others bring a rendered comment
line at position ``pos``.  Of subjects that differ the one of the greatest
position holds, and a new one changes all chunks.  A position that comes again
replaces its line, so replayed files change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from issuelens import config as C
from issuelens.functions.text import non_empty, or_empty, py_strip, truncate
from issuelens.operators.tables import BucketTable

PARTS = "issue_id string, chunk_index int, subject string, body string"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ChunkKeeper(StatefulProcessor):
    """Per issue: ``meta`` (chunks, greatest position, subject and its position, description), ``chunks`` by number."""

    def __init__(self, per_chunk: int = C.JOURNALS_PER_CHUNK):
        self.per_chunk = per_chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.meta = handle.getValueState("meta", "n int, last long, subject string, at long, described boolean, body string")
        self.chunks = handle.getMapState("chunks", "chunk int", "pos array<long>, line array<string>")

    def _chunk(self, number: int) -> tuple[list, list]:
        pos, line = self.chunks.getValue((number,))
        return list(pos), list(line)

    def _find(self, n: int, pos: int) -> int:
        """The last chunk that begins at or before ``pos``; the first if none does."""
        lo, hi = 1, n
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self._chunk(mid)[0][0] <= pos:
                lo = mid
            else:
                hi = mid - 1
        return lo

    def _insert(self, n: int, last: int, pos: int, line: str) -> tuple[int, int, int]:
        """Puts a line in its place; answers the number of chunks and the range of changed ones."""
        first = max(n, 1) if pos > last else self._find(n, pos)
        number, carry = first, (pos, line)
        while carry is not None:
            at, lines = self._chunk(number) if number <= n else ([], [])
            if carry[0] in at:  # delivered again
                lines[at.index(carry[0])] = carry[1]
                carry = None
            elif len(at) >= self.per_chunk and carry[0] > at[-1]:  # behind a full chunk
                first += number == first
                number += 1
                continue
            else:
                place = sum(p < carry[0] for p in at)
                at.insert(place, carry[0])
                lines.insert(place, carry[1])
                carry = (at.pop(), lines.pop()) if len(at) > self.per_chunk else None
            self.chunks.updateValue((number,), (at, lines))
            n = max(n, number)
            number += 1
        return n, first, number - 1

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, last, subject, at, described, body = (
            self.meta.get() if self.meta.exists() else (0, -1, None, -1, False, None))
        touched: list[tuple[int, int]] = []
        head = False
        for batch in rows:
            for r in batch.sort_values("pos", kind="stable").itertuples(index=False):
                if r.pos >= at:
                    if r.subject != subject:
                        touched.append((1, 1 << 31))
                        head = True
                    subject, at = r.subject, int(r.pos)
                if r.is_issue:
                    described, body, head = True, r.body, True
                elif r.line is not None:
                    n, lo, hi = self._insert(n, last, int(r.pos), r.line)
                    last = max(last, int(r.pos))
                    touched.append((lo, hi))
        self.meta.update((n, last, subject, at, described, body))
        out = [(key[0], 0, subject, body)] if described and head else []
        if out:
            yield pd.DataFrame(out, columns=["issue_id", "chunk_index", "subject", "body"])
        done = 0
        for lo, hi in sorted(touched):
            for number in range(max(lo, done + 1), min(hi, n) + 1):
                yield pd.DataFrame([(key[0], number, subject, "\n".join(self._chunk(number)[1]))],
                                   columns=["issue_id", "chunk_index", "subject", "body"])
                done = number
            done = max(done, min(hi, n))

    def close(self) -> None:
        pass


def comment_line(user_name: Column, notes: Column) -> Column:
    """A rendered comment, null for one without notes."""
    return F.when(non_empty(notes), F.concat(F.lit("- "), user_name, F.lit(": "), notes))


def chunk_updates(updates: DataFrame, per_chunk: int = C.JOURNALS_PER_CHUNK,
                  max_text_len: int | None = C.CHUNK_MAX_TEXT_LEN) -> DataFrame:
    """The chunks ``(id, text, issue_id, chunk_index, is_description)`` that a stream of updates changes."""
    parts = updates.groupBy("issue_id").transformWithStateInPandas(
        ChunkKeeper(per_chunk), outputStructType=PARTS, outputMode="Update", timeMode="None")
    subject = or_empty("subject")
    described = py_strip(F.concat(F.lit("Subject: "), subject, F.when(
        non_empty("body"), F.concat(F.lit("\nDescription: "), F.col("body"))).otherwise(F.lit(""))))
    comments = F.concat(F.lit("Subject: "), subject, F.lit("\nComments:\n"), F.col("body"))
    first = F.col("chunk_index") == 0
    text = F.when(first, described).otherwise(comments)
    if max_text_len is not None:
        text = truncate(text, max_text_len)
    base = F.concat(F.lit("issue_"), F.col("issue_id"))
    chunk = F.when(first, base).otherwise(F.concat(base, F.lit("_chunk_"), F.col("chunk_index").cast("string")))
    return parts.select(chunk.alias("id"), text.alias("text"), "issue_id", "chunk_index", first.alias("is_description"))


@contextmanager
def _rocks_db(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """State of many keys of its own kinds needs the store on disk; the session's own choices come back."""
    wanted = {STATE_STORE: ROCKS_DB} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def chunk_table(spark: SparkSession, root: str, schema, buckets: int = 16) -> BucketTable:
    return BucketTable(spark, root, schema, "issue_id", buckets)


def run_chunk_stream(updates: DataFrame, table_root: str, checkpoint: str, partitions: int | None = None,
                     **limits) -> DataFrame:
    """Takes in every update that is there and answers the table of chunks.

    ``partitions`` of state are fixed by a checkpoint's first run; by default the session's.
    """
    spark = updates.sparkSession
    chunks = chunk_updates(updates, **limits)

    def write(batch: DataFrame, batch_id: int) -> None:
        chunk_table(batch.sparkSession, table_root, batch.schema).upsert(
            batch, lambda here, new: here.join(new.select("id"), "id", "left_anti").select(*here.columns).unionByName(new))

    with _rocks_db(spark, partitions):
        (chunks.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())
    return chunk_table(spark, table_root, chunks.schema).read()
