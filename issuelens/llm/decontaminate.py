"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are lower-cased (A-Z) and cut into words
``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.  A window is ``size`` consecutive words
of an item, or all words of a shorter item.  The automaton holds every
substring of every item; document words stream through it, and wherever the
longest match ends with a window, that window's words are hit.  Words that no
stretch of the shortest window's length shares with an item cannot be hit and
are not streamed (their Rabin-Karp hashes are looked up, vectorised).

Items go to the tasks in blocks of a bounded size (``BLOCK_BYTES`` of text; a
longer item is a block of its own), one block at a time over all documents,
so a benchmark of any size passes.

Cases: null or empty texts and items have no words; a null item_id still
hits, but is not counted or listed as an item; equal item rows count once;
rows of equal doc_id are judged one by one; empty tables give n_hit 0 or no
rows.  Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.llm import blocks as B
from issuelens.llm import tokens as K

WINDOW = 10
#: Item text that one automaton holds.
BLOCK_BYTES = 1 << 20
#: Documents of which a larger share of words is hit are rejected whole by ``clean``.
MAX_COVERAGE = 0.5
RESULT = ("n_words", "n_hit", "items", "spans")


class Automaton:
    """Suffix automaton of several word sequences, with windows noted at their states."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], size: int):
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: i for i, name in enumerate(self.names)}
        words = [w for _, w in items if len(w)]
        self.shortest = min((min(len(w), size) for w in words), default=0)
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        self.length, self.link, self.next = [0], [-1], [{}]
        coded = [(number.get(name), np.searchsorted(self.vocabulary, w).tolist()) for name, w in items if len(w)]
        for _, seq in coded:
            state = 0
            for c in seq:
                state = self._extend(state, c)
        #: state -> {window length: item numbers}
        self.noted: dict[int, dict[int, set[int]]] = {}
        for item, seq in coded:
            state = 0
            n = min(len(seq), size)
            for i, c in enumerate(seq):
                state = self.next[state][c]
                while self.length[self.link[state]] >= n:
                    state = self.link[state]
                if i + 1 >= n:
                    found = self.noted.setdefault(state, {}).setdefault(n, set())
                    if item is not None:
                        found.add(item)
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        #: state -> the nearest state on its suffix path (itself included) that has windows, or -1
        self.near = [-1] * len(self.length)
        for s in order[1:]:
            self.near[s] = s if s in self.noted else self.near[self.link[s]]
        grams = [K.windows(K.Words(None, w, w, w, np.array([0, len(w)]), None), self.shortest)[1] for w in words]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)

    def _clone(self, p: int, q: int, c: int) -> int:
        """A state for the shorter strings of ``q`` that reach it from ``p``."""
        new = len(self.length)
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.next.append(dict(self.next[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        """The state of the sequence so far plus ``c``."""
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        new = len(self.length)
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        self.next.append({})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return new

    def stream(self, seq: list[int]):
        """``(end, length, items)`` of each window that occurs in ``seq``."""
        state = match = 0
        for i, c in enumerate(seq):
            while state and c not in self.next[state]:
                state = self.link[state]
                match = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                match += 1
            at = self.near[state]
            while at > 0:
                for n, items in self.noted[at].items():
                    if n <= match:
                        yield i + 1, n, items
                at = self.near[self.link[at]]

    def hits(self, w: K.Words) -> tuple[np.ndarray, dict[int, set[int]]]:
        """Hit marks of all words, and items by document."""
        step = np.zeros(len(w.hash) + 1, np.int32)
        found: dict[int, set[int]] = {}
        if not self.shortest:
            return step[:-1] > 0, found
        at, h = K.windows(w, self.shortest)
        k = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
        at = at[self.grams[k] == h]
        if not len(at):
            return step[:-1] > 0, found
        doc = np.searchsorted(w.first, at, side="right") - 1
        # windows that touch or overlap in one document make one stretch to stream
        new = np.concatenate([[True], (at[1:] > at[:-1] + self.shortest) | (doc[1:] != doc[:-1])])
        starts = np.flatnonzero(new)
        lasts = np.append(starts[1:], len(at)) - 1
        for a, z, d in zip(at[starts].tolist(), (at[lasts] + self.shortest).tolist(), doc[starts].tolist()):
            for end, n, items in self.stream(np.searchsorted(self.vocabulary, w.hash[a:z]).tolist()):
                step[a + end - n] += 1
                step[a + end] -= 1
                found.setdefault(d, set()).update(items)
        return np.cumsum(step)[:-1] > 0, found


def item_blocks(items: DataFrame, id_col: str, text: str) -> tuple[DataFrame, int]:
    """Distinct items with a block number, and the number of blocks."""
    items = items.select(F.col(id_col).cast("string").alias("name"), F.col(text).alias("text")).where(
        F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    return items.withColumn("block", F.expr(f"pmod(xxhash64(name, text), {n})")), n


def _words(texts: list[str]) -> list[np.ndarray]:
    data, off = K.buffers(pa.array(texts, pa.string()))
    w = K.words(data, off, K.ALNUM, lower=True)
    return [w.hash[a:z] for a, z in zip(w.first[:-1], w.first[1:])]


_AUTOMATA: dict = {}


def _automaton(items, size: int) -> Automaton:
    """One automaton per worker process and broadcast, which has a name of its own."""
    key = (items.value[0], size)
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        rows = items.value[1]
        _AUTOMATA[key] = Automaton(list(zip([r[0] for r in rows], _words([r[1] for r in rows]))), size)
    return _AUTOMATA[key]


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scan(items, text: str, size: int, cut: float | None):
    """Adds one block's hits to those that earlier blocks found.

    With ``cut``, documents that are hit more are left out, and of the others
    the hit spans: one pass, so that a task holds one Python worker.
    """
    def scan(batches):
        for batch in batches:
            auto = _automaton(items, size)
            texts = batch.column(batch.schema.get_field_index(text))
            before = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("items", "spans")}
            n_words, n_hit, names, spans = [], [], [], []
            for lo, hi, data, off in K.text_slices(texts):
                w = K.words(data, off, K.ALNUM, lower=True)
                marks, found = auto.hits(w)
                n_words.extend(w.counts.tolist())
                for d in range(hi - lo):
                    old, told = before["spans"][lo + d], before["items"][lo + d]
                    if d not in found and not old and not marks[w.first[d]:w.first[d + 1]].any():
                        n_hit.append(0)
                        names.append(told)
                        spans.append(old)
                        continue
                    mine = marks[w.first[d]:w.first[d + 1]].copy()
                    for s in old:
                        mine[s["start"]:s["end"]] = True
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8))).tolist()
                    n_hit.append(int(mine.sum()))
                    names.append(sorted({*told, *(auto.names[i] for i in found.get(d, ()))}))
                    spans.append([{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2])])
            new = {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
                   "items": pa.array(names, pa.list_(pa.string())), "spans": pa.array(spans, _SPANS)}
            if cut is not None:
                new[text] = pa.array(cut_spans(texts, spans), pa.string())
            out = pa.RecordBatch.from_arrays(
                [new.get(f.name, batch.column(i)) for i, f in enumerate(batch.schema)], names=batch.schema.names)
            if cut is not None:
                out = out.filter(pa.array([h == 0 or h <= cut * n for h, n in zip(n_hit, n_words)], pa.bool_()))
            yield out
        K.give_back()
    return scan


def find_contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, text: str = "text",
                       item_id: str = "item_id", item_text: str = "text", size: int = WINDOW,
                       max_coverage: float | None = None) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids as sorted strings) and spans (maximal hit stretches of words).

    With ``max_coverage`` documents of which a larger share of words is hit
    are rejected, and the hit spans are cut out of the texts of the others.
    """
    found = docs.drop(*RESULT).withColumns({
        "n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"),
        "items": F.expr("cast(array() as array<string>)"),
        "spans": F.expr("cast(array() as array<struct<start:int,end:int>>)")})
    blocked, n = item_blocks(items, item_id, item_text)
    if n > 1:
        blocked = B.scratch_table(spark, blocked, "items")
    for b in range(n):
        rows = [(r.name, r.text) for r in blocked.where(F.col("block") == b).select("name", "text").collect()]
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, rows))
        last = max_coverage if b + 1 == n else None
        found = found.mapInArrow(_scan(shared, text, size, last), found.schema)
        if b + 1 < n:
            found = B.scratch_table(spark, found, "contamination")
    return found


def cut_spans(texts: pa.Array, spans: list) -> list[str | None]:
    """Texts without the words of their spans (and what stands between those words and the next)."""
    out: list[str | None] = []
    for lo, hi, data, off in K.text_slices(texts):
        w = K.words(data, off, K.ALNUM, lower=True, hashes=False)
        raw, _ = K.buffers(texts.slice(lo, hi - lo))
        for d in range(hi - lo):
            if not spans[lo + d]:
                out.append(texts[lo + d].as_py())
                continue
            a, z = int(w.first[d]), int(w.first[d + 1])
            parts, pos = [], int(off[d])
            for s in spans[lo + d]:
                parts.append(raw[pos:w.start[a + s["start"]]].tobytes())
                pos = int(w.start[a + s["end"]]) if a + s["end"] < z else int(off[d + 1])
            out.append(b"".join([*parts, raw[pos:off[d + 1]].tobytes()]).decode())
    return out


def clean(spark: SparkSession, docs: DataFrame, items: DataFrame, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` without contaminated spans, and without those that are mostly contamination."""
    return find_contamination(spark, docs, items, max_coverage=max_coverage)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n,
         array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS w
  FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS w
      FROM d, sizes, unnest(range(1, CAST(len(ws) - n + 2 AS BIGINT))) AS t(i)),
m AS (SELECT doc_id, i, g.n, item_id FROM g JOIN win ON g.n = win.n AND g.w = win.w),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM m, unnest(range(0, m.n)) AS u(k) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
