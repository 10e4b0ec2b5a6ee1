"""Exact nearest-neighbour search for a whole batch of questions.

Plan shape (the driver sees no question and no vector):

    questions   -> packed into blocks of at most Q_BLOCK, written once to the shared folder
    collection  -> scan (id, parent, filter columns, embedding only), packed into blocks of
                   at most ROW_BLOCK chunks
    every collection block beside every question block
      -> mapInArrow kernel: distances of the two blocks as one matrix product, a running
         partial top-``fetch_k`` per question kept across the whole partition
      -> with many partitions, a reduction per group of TREE_FANIN partitions
      -> exchange hashpartitioning(question_id)         (P x Q x fetch_k rows)
      -> windows: fetch_k window, best chunk per parent, top_k, score gate

No question x chunk pair is ever materialised as a row.  Few questions are
broadcast by Spark's own size rule and the collection is scanned once; more
are read by the tasks, block by block, beside their part of the collection.

Questions with filters are searched first, one plan for each set of columns
that filters name: an equality join of homogeneous blocks, with the asked
values as a filter on the scan, so that partitions (or row groups) that nobody
asks for are not read.  Those that found nothing, and the questions without
filters, then share one unfiltered search.

Ranking uses ``(rkey, id)`` with ``rkey = round(score, 9)`` computed once in
the kernel, so ties and last-bit differences resolve the same way everywhere,
and the kernel can cut every question to exactly ``fetch_k`` rows: a group of
identical copies (equal scores) never floods the shuffle.

A collection may hold several windows of a chunk (``documents.embed_windows``),
with the chunk's id in ``chunk_id``.  Hits are chunks, scored by their best
window; a long text takes one place however many windows it has.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens import config as C
from issuelens.functions.memory import give_back
from issuelens.session import scratch_path

DEFAULT_FILTER_COLS = ("status", "priority", "project_id")
RANK_DIGITS = 9
OUT_DIGITS = 6
#: Chunks and questions of a block: one distance matrix has at most 16 MB.
ROW_BLOCK = 2048
Q_BLOCK = 1024
#: Bytes of vectors that a task packs at once, where blocks of many filter values grow side by side.
PACK_BYTES = 64 << 20
#: Bytes that a few rows held as a table of their own take beside their values.
PART_BYTES = 2 << 10
#: Candidates that a task holds at once before it passes them on.
HELD_ROWS = 1_000_000
#: Distinct filter combinations up to which the asked values become a filter on the scan.
MAX_PRUNED = 1000
# Above this many collection partitions, candidates are first reduced in
# groups of partitions before the final exchange by question.
TREE_FANIN = 64

CANDIDATE_SCHEMA = T.StructType([
    T.StructField("question_id", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("parent", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("rkey", T.DoubleType()),
])


@dataclass(frozen=True)
class SearchSpec:
    top_k: int = C.TOP_K
    deduplicate: bool = True
    score_threshold: float | None = None
    metric: str = "l2sq"             # l2sq (store default), l2, cosine
    fallback: bool = True            # unfiltered retry when filtered is empty
    filter_cols: tuple[str, ...] = DEFAULT_FILTER_COLS
    extra: dict = field(default_factory=dict)

    @property
    def fetch_k(self) -> int:
        return self.top_k * C.OVERFETCH if self.deduplicate else self.top_k


# ---------------------------------------------------------------------------
# Blocks (packed inside tasks, one Arrow batch at a time)
# ---------------------------------------------------------------------------

def _groups(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Rows of each combination of key values, nulls included."""
    code = np.zeros(batch.num_rows, np.int64)
    for key in keys:
        one = batch.column(key).dictionary_encode(null_encoding="encode")
        code = code * (len(one.dictionary) + 1) + np.asarray(one.indices)
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1) if len(order) else ():
        yield tuple(batch.column(key)[rows[0]].as_py() for key in keys), rows


def _packer(keys: Sequence[str], lists: Sequence[str], sort: str | None, size: int) -> Callable:
    """Rows (keys, lists, vec) into blocks of one key combination: ``(keys, lists as arrays, vecs flat, dim)``."""
    def block(key: tuple, parts: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(parts)
        if sort:
            t = t.take(pc.sort_indices(t, sort_keys=[(sort, "ascending")]))
        t = t.combine_chunks()
        vec = t.column("vec").combine_chunks()
        lengths = np.unique(np.asarray(pc.list_value_length(vec)))
        if len(lengths) > 1:
            raise ValueError(f"vectors of different dimensions: {lengths.tolist()}")
        cols = [pa.array([v], pa.string()) for v in key]
        for values in (*(t.column(c).combine_chunks() for c in lists), vec.flatten()):
            cols.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
        return pa.record_batch([*cols, pa.array(lengths, pa.int32())], names=[*keys, *lists, "vecs", "dim"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[pa.Table]] = {}
        rows: dict[tuple, int] = {}
        nbytes = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for key, at in _groups(batch, keys):
                mine = table.take(pa.array(at)) if len(at) < batch.num_rows else table
                while mine.num_rows:
                    part = mine.slice(0, size - rows.get(key, 0))
                    mine = mine.slice(part.num_rows)
                    held.setdefault(key, []).append(part)
                    rows[key] = rows.get(key, 0) + part.num_rows
                    nbytes += part.nbytes + PART_BYTES
                    if rows[key] == size:
                        nbytes -= sum(t.nbytes + PART_BYTES for t in held[key])
                        yield block(key, held.pop(key))
                        rows.pop(key)
            if nbytes > PACK_BYTES:
                for key in list(held):
                    yield block(key, held.pop(key))
                rows.clear()
                nbytes = 0
        for key in list(held):
            yield block(key, held.pop(key))
        give_back()

    return pack


def question_blocks(spark: SparkSession, questions: DataFrame, filter_cols: Sequence[str], size: int = Q_BLOCK) -> DataFrame:
    """``questions`` (question_id, vector, filter columns) as written blocks of equal filters, numbered."""
    given = [c for c in filter_cols if c in questions.columns]
    keys = [f"q_{c}" for c in filter_cols]
    rows = questions.select(*((F.col(c).cast("string") if c in given else F.lit(None).cast("string")).alias(f"q_{c}")
                              for c in filter_cols),
                            F.col("question_id").cast("long").alias("qids"), F.col("vector").cast("array<double>").alias("vec"))
    schema = ", ".join([*(f"{k} string" for k in keys), "qids array<long>, vecs array<double>, dim int"])
    packed = rows.where("vec is not null").mapInArrow(_packer(keys, ["qids"], None, size), schema)
    packed = packed.select(*keys, "qids", F.col("vecs").alias("qvecs"), F.col("dim").alias("qdim"),
                           F.monotonically_increasing_id().alias("block"))
    path = scratch_path(spark, f"questions/{uuid.uuid4().hex}")
    packed.write.parquet(path)
    return spark.read.schema(packed.schema).parquet(path)


def collection_blocks(collection: DataFrame, keys: Sequence[str], size: int = ROW_BLOCK) -> DataFrame:
    """The collection as blocks of equal ``keys``, their chunks in order of id."""
    chunk = F.col("chunk_id") if "chunk_id" in collection.columns else F.col("id")
    # a chunk without a parent issue is its own parent (V8)
    rows = collection.where("embedding is not null").select(
        *(F.col(c).cast("string").alias(f"c_{c}") for c in keys), chunk.alias("ids"),
        F.coalesce(F.col("parent"), chunk).alias("parents"), F.col("embedding").cast("array<double>").alias("vec"))
    names = [f"c_{c}" for c in keys]
    schema = ", ".join([*(f"{k} string" for k in names), "ids array<string>, parents array<string>, vecs array<double>, dim int"])
    return rows.mapInArrow(_packer(names, ["ids", "parents"], "ids", size), schema)


# ---------------------------------------------------------------------------
# Kernel (runs inside Python workers, one pair of blocks at a time)
# ---------------------------------------------------------------------------

def _distances(emb: np.ndarray, qmat: np.ndarray, metric: str) -> np.ndarray:
    dots = emb @ qmat.T
    if metric == "cosine":
        en = np.linalg.norm(emb, axis=1)
        qn = np.linalg.norm(qmat, axis=1)
        denom = en[:, None] * qn[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            cos = np.where(denom > 0, dots / denom, 0.0)
        return 1.0 - cos
    d = (emb * emb).sum(axis=1)[:, None] + (qmat * qmat).sum(axis=1)[None, :] - 2.0 * dots
    np.maximum(d, 0.0, out=d)
    if metric == "l2":
        np.sqrt(d, out=d)
    return d


def _places(group: np.ndarray) -> np.ndarray:
    """Place of each row in its run of equal ``group``."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return np.arange(len(group)) - np.repeat(first, np.diff(np.concatenate([first, [len(group)]])))


class _Best:
    """Running best ``k`` chunks of each question of one block, by ``(key, id)``."""

    def __init__(self, qids: np.ndarray, k: int, windows: bool):
        self.qids, self.k, self.windows = qids, k, windows
        self.kth = np.full(len(qids), np.inf)
        self.q = np.zeros(0, np.int64)
        self.key = self.score = np.zeros(0)
        self.id = self.parent = np.zeros(0, object)

    def add(self, scores: np.ndarray, ids: np.ndarray, parents: np.ndarray) -> None:
        """``scores``: chunks (in order of id, each once) by questions."""
        keys = np.round(scores, RANK_DIGITS)
        bound = self.kth
        if len(keys) > self.k:
            bound = np.minimum(bound, np.partition(keys, self.k - 1, axis=0)[self.k - 1])
        r, c = np.nonzero((keys <= bound) & np.isfinite(keys))
        order = np.lexsort((r, keys[r, c], c))
        order = order[_places(c[order]) < self.k] if len(order) else order
        r, c = r[order], c[order]
        if not len(r):
            return
        fresh = not len(self.q)
        self.q = np.concatenate([self.q, c])
        self.key = np.concatenate([self.key, keys[r, c]])
        self.score = np.concatenate([self.score, scores[r, c]])
        self.id = np.concatenate([self.id, ids[r]])
        self.parent = np.concatenate([self.parent, parents[r]])
        if not fresh:
            self._cut()
        last = _places(self.q) == self.k - 1
        self.kth[self.q[last]] = self.key[last]

    def _keep(self, rows: np.ndarray) -> None:
        self.q, self.key, self.score, self.id, self.parent = (
            a[rows] for a in (self.q, self.key, self.score, self.id, self.parent))

    def _cut(self) -> None:
        if self.windows:  # windows of one chunk may lie in several blocks: the best one stays
            code = pd.factorize(self.id)[0]
            order = np.lexsort((self.key, code, self.q))
            self._keep(order[_places(self.q[order] * (code.max() + 1) + code[order]) == 0])
        self._keep(np.lexsort((self.key, self.q)))
        place = _places(self.q)
        edge = np.flatnonzero(place == self.k)
        tied = edge[self.key[edge] == self.key[edge - 1]]
        keep = place < self.k
        for e in tied:  # a tie across the cut goes by id
            lo = e - self.k + int(np.searchsorted(self.key[e - self.k:e], self.key[e]))
            hi = e
            while hi < len(self.q) and self.q[hi] == self.q[e] and self.key[hi] == self.key[e]:
                hi += 1
            by_id = lo + np.argsort(self.id[lo:hi], kind="stable")
            keep[lo:hi] = False
            keep[by_id[:e - lo]] = True
        self._keep(np.flatnonzero(keep))

    def rows(self) -> pa.RecordBatch:
        return pa.record_batch([pa.array(self.qids[self.q], pa.int64()), pa.array(self.id, pa.string()),
                                pa.array(self.parent, pa.string()), pa.array(self.score), pa.array(self.key)],
                               names=CANDIDATE_SCHEMA.names)


def _make_kernel(fetch_k: int, metric: str, windows: bool) -> Callable:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for batch in batches:
            col = {n: batch.column(n) for n in ("ids", "parents", "vecs", "dim", "qids", "qvecs", "qdim", "block")}
            for i in range(batch.num_rows):
                dim, qdim = col["dim"][i].as_py(), col["qdim"][i].as_py()
                if dim != qdim:
                    raise ValueError(f"embedding dimension mismatch: collection has {dim}, questions have {qdim}")
                emb = np.asarray(col["vecs"][i].values).reshape(-1, dim)
                qmat = np.asarray(col["qvecs"][i].values).reshape(-1, dim)
                ids, parents = (col[n][i].values.to_numpy(zero_copy_only=False) for n in ("ids", "parents"))
                block = col["block"][i].as_py()
                if block not in best:
                    best[block] = _Best(np.asarray(col["qids"][i].values), fetch_k, windows)
                scores = _distances(emb, qmat, metric)
                if windows:
                    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                    scores, ids, parents = np.minimum.reduceat(scores, first, axis=0), ids[first], parents[first]
                best[block].add(scores, ids, parents)
                if sum(len(b.q) for b in best.values()) > HELD_ROWS:
                    for b in best.values():
                        yield b.rows()
                    best.clear()
            batch = col = emb = qmat = None  # up to 64 MB that need not stay while the next ones are read
        for b in best.values():
            yield b.rows()
        best.clear()
        give_back()

    return kernel


# ---------------------------------------------------------------------------
# Planning: sizes and filter values reach the driver, questions do not
# ---------------------------------------------------------------------------

def _beside(collection: DataFrame, blocks: DataFrame, spec: SearchSpec, keys: Sequence[str] = ()) -> DataFrame:
    """Candidates of the question ``blocks`` among the collection's chunks of equal ``keys``."""
    coll = collection_blocks(collection, keys, int(spec.extra.get("row_block", ROW_BLOCK)))
    asked = blocks.select(*(f"q_{c}" for c in keys), "qids", "qvecs", "qdim", "block")
    if keys:
        pairs = coll.join(asked, [F.col(f"c_{c}") == F.col(f"q_{c}") for c in keys])
    else:
        pairs = coll.crossJoin(asked)  # blocks: every stored block has to meet every block of questions
    pairs = pairs.select("ids", "parents", "vecs", "dim", "qids", "qvecs", "qdim", "block")
    cand = pairs.mapInArrow(_make_kernel(spec.fetch_k, spec.metric, "chunk_id" in collection.columns), CANDIDATE_SCHEMA)
    return _tree_level(cand, collection, spec, int(spec.extra.get("fanin", TREE_FANIN)))


def _filtered_plans(collection: DataFrame, blocks: DataFrame, spec: SearchSpec) -> Iterator[DataFrame]:
    """Candidates within filters, a plan for each set of columns that some question filters by."""
    names = [f"q_{c}" for c in spec.filter_cols]
    combos = blocks.select(*names).distinct().limit(MAX_PRUNED + 1).collect()
    known = len(combos) <= MAX_PRUNED
    for n in range(1, len(names) + 1):
        for cols in combinations(spec.filter_cols, n):
            mine = [r for r in combos if all((r[f"q_{c}"] is not None) == (c in cols) for c in spec.filter_cols)]
            if known and not mine:
                continue
            some = blocks
            scan = collection
            for c in spec.filter_cols:
                some = some.where(F.col(f"q_{c}").isNotNull() if c in cols else F.col(f"q_{c}").isNull())
                if known and c in cols:
                    scan = scan.where(F.col(c).isin(*sorted({r[f"q_{c}"] for r in mine})))
            yield _beside(scan, some, spec, cols)


def candidates(spark: SparkSession, collection: DataFrame, questions: DataFrame, spec: SearchSpec,
               filtered: bool | None = None) -> DataFrame:
    """Kernel output (``CANDIDATE_SCHEMA``): every question within its filters, or within none of them.

    ``filtered``: True searches only the questions with filters, False only
    those without; None both.
    """
    blocks = question_blocks(spark, questions, spec.filter_cols, int(spec.extra.get("q_block", Q_BLOCK)))
    plans = []
    if filtered is not True:
        free = blocks
        for c in spec.filter_cols:
            free = free.where(F.col(f"q_{c}").isNull())
        plans.append(_beside(collection, free, spec))
    if filtered is not False:
        plans += _filtered_plans(collection, blocks, spec)
    out = spark.createDataFrame([], CANDIDATE_SCHEMA)
    for i, p in enumerate(plans):
        out = out.unionByName(p) if i else p
    return out


def _tree_level(cand: DataFrame, coll: DataFrame, spec: SearchSpec, fanin: int) -> DataFrame:
    """With many collection partitions, reduce candidates per group of
    ``fanin`` partitions first, so no question receives more than
    ``partitions / fanin * fetch_k`` rows in the final exchange."""
    n_parts = coll.rdd.getNumPartitions()
    if n_parts <= fanin:
        return cand
    g = (F.spark_partition_id() / F.lit(fanin)).cast("int")
    w = Window.partitionBy("question_id", "_g").orderBy("rkey", "id")
    return (_one_per_chunk(cand.withColumn("_g", g), coll, "_g").withColumn("_r", F.row_number().over(w))
            .where(F.col("_r") <= spec.fetch_k).drop("_g", "_r"))


def _one_per_chunk(cand: DataFrame, coll: DataFrame, *within: str) -> DataFrame:
    """The best window of each chunk per question: the cuts to ``fetch_k`` count chunks."""
    if "chunk_id" not in coll.columns:
        return cand
    w = Window.partitionBy("question_id", *within, "id").orderBy("rkey")
    return cand.withColumn("_w", F.row_number().over(w)).where(F.col("_w") == 1).drop("_w")


def rank_candidates(cand: DataFrame, coll: DataFrame, spec: SearchSpec) -> DataFrame:
    """V7-V10 on the candidate rows; one shuffle by question id."""
    cand = _one_per_chunk(cand.repartition("question_id"), coll)
    by_score = Window.partitionBy("question_id").orderBy("rkey", "id")
    hits = cand.withColumn("_fetch", F.row_number().over(by_score)).where(F.col("_fetch") <= spec.fetch_k)
    if spec.deduplicate:
        w_parent = Window.partitionBy("question_id", "parent").orderBy("rkey", "id")
        hits = hits.withColumn("_p", F.row_number().over(w_parent)).where(F.col("_p") == 1)
    hits = hits.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= spec.top_k)
    if spec.score_threshold is not None:
        best = F.min("rkey").over(Window.partitionBy("question_id"))
        hits = hits.withColumn("_best", best).where(F.col("_best") <= F.lit(float(spec.score_threshold)))
    return hits.select("question_id", "id", "parent", F.round("score", OUT_DIGITS).alias("score"),
                       F.col("score").alias("raw_score"), F.col("rank").cast("bigint").alias("rank"))


def _has_filter(spec: SearchSpec):
    some = F.lit(False)
    for c in spec.filter_cols:
        some = some | F.col(c).isNotNull()
    return some


def search_bounded(spark: SparkSession, collection: DataFrame, questions: DataFrame,
                   spec: SearchSpec = SearchSpec()) -> tuple[DataFrame, int]:
    """``search`` plus a proven upper bound on its row count (questions x top_k)."""
    return search(spark, collection, questions, spec), questions.select("question_id").count() * spec.top_k


def search(spark: SparkSession, collection: DataFrame, questions: DataFrame,
           spec: SearchSpec = SearchSpec()) -> DataFrame:
    """Full retrieval (V5-V12, R6) for a DataFrame of questions.

    collection: ``id, parent, <filter cols>, embedding`` (and ``chunk_id`` where rows are windows of chunks)
    questions:  ``question_id, vector, <filter cols>`` (NULL = no filter)
    returns:    ``question_id, id, parent, score, raw_score, rank, filtered`` (id: of the chunk)
    """
    model = spec.extra.get("embed_model")
    if model and "embed_model" in collection.columns:
        # Never rank vectors of another model; parquet min/max stats
        # make this check skip every row group written by the same model
        other = collection.where(F.col("embed_model") != F.lit(model)).select("embed_model").limit(1).collect()
        if other:
            raise ValueError(f"collection holds vectors of {other[0][0]!r}, questions use {model!r}")
    given = [c for c in spec.filter_cols if c in questions.columns]
    if not given:
        cand = candidates(spark, collection, questions, spec, filtered=False)
        return rank_candidates(cand, collection, spec).withColumn("filtered", F.lit(False))
    # vectors may come from a model: computed once, written, read by both searches
    path = scratch_path(spark, f"asked/{uuid.uuid4().hex}")
    asked = questions.select("question_id", "vector", *given)
    for c in spec.filter_cols:
        if c not in given:
            asked = asked.withColumn(c, F.lit(None).cast("string"))
    asked.write.parquet(path)
    asked = spark.read.schema(asked.schema).parquet(path)
    with_filter = asked.where(_has_filter(spec))
    found = rank_candidates(candidates(spark, collection, with_filter, spec, filtered=True), collection, spec)
    found = found.withColumn("filtered", F.lit(True))
    path = scratch_path(spark, f"hits/{uuid.uuid4().hex}")
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    rest = asked.where(~_has_filter(spec)).select("question_id", "vector")
    if spec.fallback:
        # What found nothing within its filters (or lost it to the gate) is searched again without them
        again = with_filter.join(found.select("question_id").distinct(), "question_id", "left_anti")
        rest = rest.unionByName(again.select("question_id", "vector"))
    free = rank_candidates(candidates(spark, collection, rest, spec, filtered=False), collection, spec)
    return found.unionByName(free.withColumn("filtered", F.lit(False)))


def fetch_window(spark: SparkSession, collection: DataFrame, questions: DataFrame,
                 spec: SearchSpec) -> DataFrame:
    """The ranked ``fetch_k`` window before de-duplication (within filters, no fallback).

    Rows: ``question_id, id, parent, score, fetch_rank``; used to evaluate
    several K / threshold settings from one scan (Q7).
    """
    cand = _one_per_chunk(candidates(spark, collection, questions, spec).repartition("question_id"), collection)
    w = Window.partitionBy("question_id").orderBy("rkey", "id")
    return (cand.withColumn("fetch_rank", F.row_number().over(w))
            .where(F.col("fetch_rank") <= spec.fetch_k)
            .select("question_id", "id", "parent", F.round("score", OUT_DIGITS).alias("score"),
                    F.col("rkey"), F.col("fetch_rank").cast("bigint").alias("fetch_rank")))
