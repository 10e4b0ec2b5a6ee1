"""Approximate nearest neighbours with balanced posting lists.

Centroids are fitted on a bounded sample by k-means that charges clusters for
their size.  Every vector goes to the posting list of its nearest centroid
and, near a border, to those of others that are almost as near (REPLICAS at
most).  Centroids are found by beam search in an in-memory graph of their
nearest neighbours.  A query searches the lists whose centroid is not farther
than a ratio times the nearest one; the ratio is the one that finds TARGET of
the true neighbours within the sample.

A list of more than PART vectors, from copies for example, is split into
parts, and its queries go to every part, so no task holds a whole hot list.
Lists and parts give their best k, which are ranked by query.

Cases: vectors that are null, all zero, of another length than most, or that
hold null or non-finite components take no part, nor do rows without an id;
equal scores go to the smaller id; copies are candidates one by one; rows of
a query's id are its own; with fewer than k other vectors all are returned;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.llm import blocks as B

K_NEAREST = 5
#: Vectors a list holds on average, before replicas, and lists at most.
LIST_SIZE, MAX_LISTS = 512, 16_384
#: Vectors that centroids and the pruning ratio are fitted on, at most about.
SAMPLE = 20_000
PROBES = 400
TARGET = 0.98
REPLICAS, BORDER = 3, 1.1
DEGREE, BEAM = 24, 32
PART = 4096
#: A query searches on, in order of distance, until its lists hold so many vectors.
LEAST = 256


@dataclass
class Index:
    centroids: np.ndarray  # unit rows, float32
    graph: np.ndarray      # neighbours of each centroid
    entries: np.ndarray    # where a search begins
    ratio: float = 1.0

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For unit rows the ``beam`` nearest centroids found, by distance, and the distances."""
        n = len(self.centroids)
        beam = min(beam, n)
        ids = np.broadcast_to(self.entries[:beam], (len(x), min(beam, len(self.entries)))).copy()
        score = np.einsum("bd,bkd->bk", x, self.centroids[ids])
        ids = np.pad(ids, ((0, 0), (0, beam - ids.shape[1])), constant_values=n)
        score = np.pad(score, ((0, 0), (0, beam - score.shape[1])), constant_values=-np.inf)
        done = ids == n
        row = np.arange(len(x))
        while True:
            best = np.where(done, -np.inf, score).argmax(1)
            live = np.flatnonzero(~done[row, best])
            if not len(live):
                break
            done[live, best[live]] = True
            new = self.graph[ids[live, best[live]]]
            got = np.einsum("bd,bkd->bk", x[live], self.centroids[new])
            all_ids = np.concatenate([ids[live], new], 1)
            all_score = np.concatenate([score[live], got], 1)
            all_done = np.concatenate([done[live], np.zeros(new.shape, bool)], 1)
            # one of each centroid: its first, which is the expanded one if either is
            order = np.argsort(all_ids, axis=1, kind="stable")
            sorted_ids = np.take_along_axis(all_ids, order, 1)
            again = np.zeros(order.shape, bool)
            again[:, 1:] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
            s = np.take_along_axis(all_score, order, 1)
            s[again] = -np.inf
            top = np.argsort(-s, axis=1, kind="stable")[:, :beam]
            ids[live] = np.take_along_axis(sorted_ids, top, 1)
            score[live] = np.take_along_axis(s, top, 1)
            d = np.take_along_axis(np.take_along_axis(all_done, order, 1), top, 1)
            empty = ~np.isfinite(score[live])
            ids[live] = np.where(empty, n, ids[live])
            done[live] = d | empty
        order = np.argsort(-score, axis=1, kind="stable")
        score = np.take_along_axis(score, order, 1)
        return np.take_along_axis(ids, order, 1), np.sqrt(np.maximum(2 - 2 * score, 0))

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, list)`` of the posting lists that vectors belong to."""
        ids, dist = self.nearest(x, BEAM)
        ids, dist = ids[:, :REPLICAS], dist[:, :REPLICAS]
        take = (dist <= BORDER * dist[:, :1]) & np.isfinite(dist)
        take[:, 0] = True
        row, k = np.nonzero(take)
        return row, ids[row, k]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _graph(c: np.ndarray) -> np.ndarray:
    n = len(c)
    out = np.zeros((n, min(DEGREE, n)), np.int64)
    for lo in range(0, n, 1024):
        s = c[lo:lo + 1024] @ c.T
        out[lo:lo + 1024] = np.argsort(-s, axis=1, kind="stable")[:, :out.shape[1]]
    # a ring joins what neighbourhoods leave apart
    out[:, -1] = (np.arange(n) + 1) % n
    return out


def build(sample: np.ndarray, n_vectors: int, rounds: int = 12, seed: int = 7) -> Index:
    """The index of a sample (unit rows) of ``n_vectors`` vectors."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample.astype(np.float32), axis=0)
    n = max(1, min(MAX_LISTS, round(n_vectors / LIST_SIZE), len(distinct)))
    c = distinct[rng.choice(len(distinct), n, replace=False)]
    charge = np.zeros(n, np.float32)
    x = sample.astype(np.float32)
    for _ in range(rounds if n > 1 else 0):
        own = np.concatenate([(x[lo:lo + 2048] @ c.T - charge).argmax(1) for lo in range(0, len(x), 2048)])
        size = np.bincount(own, minlength=n)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(norm > 1e-6, total / np.maximum(norm, 1e-6), c).astype(np.float32)
        charge += 0.02 * (size * n / len(x) - 1).clip(-1, 3)
        charge -= charge.min()
    index = Index(c, _graph(c), np.linspace(0, n - 1, min(8, n)).astype(np.int64))
    index.ratio = _ratio(index, sample, rng)
    return index


def _ratio(index: Index, sample: np.ndarray, rng) -> float:
    """How much farther than the nearest centroid the lists of TARGET of the true neighbours are."""
    if len(sample) < 2 or len(index.centroids) == 1:
        return 2.0
    probes = rng.choice(len(sample), min(PROBES, len(sample)), replace=False)
    near = []
    for lo in range(0, len(probes), 50):
        part = probes[lo:lo + 50]
        s = sample[part] @ sample.T
        s[np.arange(len(part)), part] = -2
        k = min(K_NEAREST, len(sample) - 1)
        near.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    near = np.concatenate(near)
    member = np.zeros((len(sample), len(index.centroids)), bool)
    for lo in range(0, len(sample), 1024):
        row, lists = index.lists_of(sample[lo:lo + 1024].astype(np.float32))
        member[lo + row, lists] = True
    dist = np.sqrt(np.maximum(2 - 2 * (sample[probes] @ index.centroids.T), 0))
    need = np.stack([np.where(member[near[:, k]], dist, np.inf).min(1) for k in range(near.shape[1])], 1)
    return float(np.quantile(need / np.maximum(dist.min(1, keepdims=True), 1e-9), TARGET)) + 1e-9


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """``(id, vec)`` of the vectors that take part, and how many there are."""
    inf = F.lit(float("inf"))
    ok = (F.col("id").isNotNull() & F.col("vec").isNotNull()
          & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("vec", lambda x: x != 0))
    found = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(ok)
    lengths = found.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"))
    top = lengths.orderBy(F.desc("n"), "dim").first()
    if top is None:
        return found, 0
    return found.where(F.size("vec") == top.dim), top.n


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _post(shared):
    def post(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            for lo in range(0, len(x), 1024):
                part = batch.slice(lo, 1024)
                row, lists = shared.value.lists_of(unit(x[lo:lo + 1024]).astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array(lists), part.column(0).take(pa.array(row)),
                                                  part.column(1).take(pa.array(row))], names=["list", "id", "vec"])
    return post


def _ask(shared, sizes: np.ndarray):
    """The parts of the lists that each query searches."""
    def ask(batches):
        index = shared.value
        for batch in batches:
            x = _matrix(batch.column(1))
            for lo in range(0, len(x), 256):
                part = batch.slice(lo, 256)
                u = unit(x[lo:lo + 256]).astype(np.float32)
                beam = min(64, len(index.centroids))
                while True:  # widen until the beam reaches past the ratio and holds enough vectors
                    ids, dist = index.nearest(u, beam)
                    known = np.isfinite(dist)
                    held = np.where(known, sizes[np.minimum(ids, len(sizes) - 1)], 0)
                    before = np.cumsum(held, 1) - held
                    take = known & ((dist <= index.ratio * dist[:, :1]) | (before < LEAST))
                    if beam >= len(index.centroids) or not take[:, -1].any():
                        break
                    beam = min(beam * 2, len(index.centroids))
                row, k = np.nonzero(take)
                lists = ids[row, k]
                parts = -(-sizes[lists] // PART)
                row, lists = np.repeat(row, parts), np.repeat(lists, parts)
                of = np.arange(len(lists)) - np.repeat(np.cumsum(parts) - parts, parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists), pa.array(of), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row))],
                    names=["list", "part", "id", "vec"])
    return ask


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of one vector with rows, in double precision; equal rows get equal values."""
    return (v * q).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((q * q).sum()))


def _best(k: int):
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        ids, v = left.column("id").to_numpy(), _matrix(left.column("vec")).astype(np.float64)
        asked, q = right.column("id").to_numpy(), _matrix(right.column("vec")).astype(np.float64)
        u = unit(v)
        for lo in range(0, len(q), 256):
            s = unit(q[lo:lo + 256]) @ u.T
            s[asked[lo:lo + 256, None] == ids[None, :]] = -2
            kth = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
            for i in range(len(s)):
                near = np.flatnonzero((s[i] >= kth[i] - 1e-9) & (s[i] > -1.5))
                exact = cosines(q[lo + i], v[near])
                top = np.lexsort((ids[near], -exact))[:k]
                out.append((np.full(len(top), asked[lo + i]), ids[near[top]], exact[top]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=_FOUND)
    return best


def fit(spark: SparkSession, found: DataFrame, n: int) -> Index:
    share = min(1.0, SAMPLE / n)
    rows = found.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000).select("vec").toArrow()
    if not rows.num_rows:
        rows = found.select("vec").limit(1).toArrow()
    sample = unit(_matrix(rows.column("vec")))
    return build(sample[np.lexsort(sample.T[::-1])], n)


def nearest(spark: SparkSession, vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding",
            k: int = K_NEAREST) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of each vector for which ``is_query`` of ``id`` holds."""
    schema = "query_id long, rank int, vec_id long, score double"
    found, n = usable(vectors, id_col, vec_col)
    if not n:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(fit(spark, found, n))
    lists = len(shared.value.centroids)
    kind = found.schema["vec"].dataType
    posts = B.scratch_table(spark, found.mapInArrow(_post(shared), T.StructType([
        T.StructField("list", T.LongType()), T.StructField("id", T.LongType()), T.StructField("vec", kind)])), "postings")
    sizes = np.zeros(lists, np.int64)
    for r in posts.groupBy("list").agg(F.count("*").alias("n")).collect():
        sizes[r["list"]] = r.n
    queries = found.where(is_query(F.col("id"))).mapInArrow(_ask(shared, sizes), T.StructType([
        T.StructField("list", T.LongType()), T.StructField("part", T.LongType()), T.StructField("id", T.LongType()),
        T.StructField("vec", kind)]))
    parts = F.element_at(F.lit(np.maximum(-(-sizes // PART), 1).tolist()), (F.col("list") + 1).cast("int"))
    posts = posts.withColumn("part", F.pmod(F.xxhash64("id"), parts.cast("long")))
    got = (posts.groupBy("list", "part").cogroup(queries.groupBy("list", "part"))
           .applyInArrow(_best(k), "query_id long, vec_id long, score double"))
    got = got.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id 50 divides."""
    return nearest(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0)
