"""Centroid clustering with heap-ordered bounds, in exact integers.

A vector keeps one number: the gap between its distance to the second nearest
centroid (lower bound) and to its own (upper bound), plus what its cluster had
drifted when it was measured.  When centroids move, a cluster's drift grows by
its own step and by the largest step of any other: no gap of its vectors can
shrink by more.  Each cluster of a block keeps its vectors in a heap by that
number, so those whose gap may have closed lie on top; only they are popped,
compared with all centroids and pushed again.  Sums and counts change by the
vectors that changed clusters.

Vectors lie in blocks of a written table with their assignment and heaps; a
pass reads the last table, writes the next and gives each block's changed sums
to one aggregation.  The driver holds the k centroids, their sums and drifts.

Bounds are floating point and give way by more than their rounding, so a close
call is measured again; distances, sums and means are exact integers.

Cases: vectors that are null, of another length, or with null or non-finite
components take no part; fewer vectors than k: each is a centroid; repeated
rows are vectors of their own, and equal first hashes go by components; a null
id hashes as the word null; ties go to the smaller number; an empty table
gives no rows; other columns are not looked at.  Scaled components beyond
LIMIT count as LIMIT, so that distances fit a long; an inertia that does not
fit is null.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.llm import blocks as B

DIMS, SCALE = 64, 256
K, ROUNDS, SEED = 40, 5, 2
#: Largest scaled component.
LIMIT = 1 << 27
#: Vectors of a block at most.
BLOCK = 4096
#: Bounds give way by this share of the distances, and by this much.
SLACK = 1e-9

_VECTORS = "ids array<long>, x array<int>"
#: own: cluster of each vector; heap_*: all heaps of the block one after another, heap_at where each begins;
#: changed_*: clusters whose sums change, by how many vectors, and by which sums (one list after another).
_STATE = (f"{_VECTORS}, own array<int>, heap_at array<int>, heap_key array<double>, heap_vec array<int>,"
          " changed array<int>, changed_n array<long>, changed_sum array<array<long>>, rescanned long")


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dims: int = DIMS,
                    scale: int = SCALE) -> DataFrame:
    """``(id, v)``: the vectors that take part, as integers floor(scale * x)."""
    whole = (f"v is not null and size(v) = {dims}"
             " and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    scaled = f"transform(v, x -> cast(floor(greatest(least({scale} * x, {LIMIT}D), {-LIMIT}D)) as int))"
    df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return df.where(whole).select("id", F.expr(scaled).alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``<seed>:<id>``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0

    def block() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, x = (table.column(c).combine_chunks() for c in ("id", "v"))
        return pa.record_batch([_lists([ids]), _lists([x.flatten()])], names=["ids", "x"])

    for batch in batches:
        lo = 0
        while lo < batch.num_rows:
            take = min(BLOCK - rows, batch.num_rows - lo)
            held.append(batch.slice(lo, take))
            rows += take
            lo += take
            if rows == BLOCK:
                yield block()
                held, rows = [], 0
    if rows:
        yield block()


def _lists(values: list) -> pa.Array:
    """A list array of the given arrays."""
    arrays = [v if isinstance(v, pa.Array) else pa.array(v) for v in values]
    at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.concat_arrays(arrays))


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances (vectors by centroids), int64."""
    most = max(np.abs(x).max(initial=0), np.abs(centers).max(initial=0))
    if 4 * x.shape[1] * int(most) ** 2 < 1 << 53:  # every partial sum is an integer that a double holds
        a, c = x.astype(np.float64), centers.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (a @ c.T)).astype(np.int64)
    out = np.empty((len(x), len(centers)), np.int64)
    for j, c in enumerate(centers):
        step = x.astype(np.int64) - c
        out[:, j] = (step * step).sum(1)
    return out


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector (ties: the smaller number), and the gap to the second, rounded down."""
    d = squared_distances(x, centers)
    own = d.argmin(1)
    rows = np.arange(len(x))
    upper = np.sqrt(d[rows, own].astype(np.float64))
    if len(centers) == 1:
        return own, np.full(len(x), np.inf)
    d[rows, own] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(1).astype(np.float64))
    return own, lower - upper - SLACK * (1 + lower + upper)


class Heaps:
    """The heaps of one block: per cluster, (gap + drift when measured, vector), least first."""

    def __init__(self, at: np.ndarray, key: np.ndarray, vec: np.ndarray):
        self.at, self.key, self.vec = at, key, vec
        self.opened: dict[int, list[tuple[float, int]]] = {}

    def heap(self, j: int) -> list[tuple[float, int]]:
        if j not in self.opened:
            lo, hi = self.at[j], self.at[j + 1]
            self.opened[j] = list(zip(self.key[lo:hi].tolist(), self.vec[lo:hi].tolist()))
        return self.opened[j]

    def expired(self, drift: np.ndarray) -> list[int]:
        """Pops the vectors whose gap the drift of their cluster may have closed."""
        out = []
        for j in range(len(drift)):
            if self.at[j] < self.at[j + 1] and self.key[self.at[j]] <= drift[j]:
                heap = self.heap(j)
                while heap and heap[0][0] <= drift[j]:
                    out.append(heapq.heappop(heap)[1])
        return out

    def push(self, own: np.ndarray, key: np.ndarray, vec: np.ndarray) -> None:
        for j, k, v in zip(own.tolist(), key.tolist(), vec.tolist()):
            heapq.heappush(self.heap(j), (k, v))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, vecs = [], []
        for j in range(len(self.at) - 1):
            if j in self.opened:
                keys.append(np.array([k for k, _ in self.opened[j]], np.float64))
                vecs.append(np.array([v for _, v in self.opened[j]], np.int32))
            else:
                keys.append(self.key[self.at[j]:self.at[j + 1]])
                vecs.append(self.vec[self.at[j]:self.at[j + 1]])
        at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        return at, np.concatenate(keys), np.concatenate(vecs)


def first_heaps(own: np.ndarray, key: np.ndarray, k: int) -> Heaps:
    """Heaps of freshly measured vectors: ascending keys are a heap."""
    order = np.lexsort((key, own)).astype(np.int32)
    at = np.searchsorted(own[order], np.arange(k + 1)).astype(np.int32)
    return Heaps(at, key[order], order)


def _pass(dims: int, centers: np.ndarray, drift: np.ndarray):
    """One assignment of all blocks; blocks without state are measured whole."""
    k = len(centers)

    def changes(x: np.ndarray, old: np.ndarray | None, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for own, sign in ((new, 1), (old, -1)):
            if own is not None:
                n += sign * np.bincount(own, minlength=k)
                np.add.at(total, own, sign * x)
        touched = np.flatnonzero(n.astype(bool) | total.any(1))
        return touched.astype(np.int32), n[touched], total[touched]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                cols = {name: batch.column(name)[r].values for name in batch.schema.names
                        if name not in ("changed_sum", "rescanned")}
                x = np.asarray(cols["x"], dtype=np.int64).reshape(-1, dims)
                if "own" in cols:
                    own = np.array(cols["own"], np.int32)
                    heaps = Heaps(*(np.asarray(cols[c]) for c in ("heap_at", "heap_key", "heap_vec")))
                    again = np.array(heaps.expired(drift), np.int64)
                    new, gap = nearest(x[again], centers)
                    heaps.push(new, gap + drift[new], again)
                    moved = new != own[again]
                    changed = changes(x[again[moved]], own[again[moved]], new[moved])
                    own[again] = new
                else:
                    own, gap = nearest(x, centers)
                    own, again = own.astype(np.int32), own
                    heaps, changed = first_heaps(own, gap + drift[own], k), changes(x, None, own)
                yield pa.record_batch(
                    [batch.column("ids").slice(r, 1), batch.column("x").slice(r, 1), _lists([own]),
                     *(_lists([a]) for a in heaps.arrays()), _lists([changed[0]]), _lists([changed[1]]),
                     _lists([_lists(list(changed[2])) if len(changed[2]) else pa.array([], pa.list_(pa.int64()))]),
                     pa.array([len(again)], pa.int64())],
                    names=["ids", "x", "own", "heap_at", "heap_key", "heap_vec", "changed", "changed_n", "changed_sum",
                           "rescanned"])

    return assign


def _sum_changes(state: DataFrame, dims: int, sums: list[list[int]], counts: list[int]) -> None:
    """Adds the blocks' changes to ``sums`` and ``counts``: one row per cluster reaches the driver."""
    each = state.select(F.explode(F.arrays_zip("changed", "changed_n", "changed_sum")).alias("c"))
    part = [F.sum(F.col("c.changed_sum")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    for row in each.groupBy(F.col("c.changed").alias("j")).agg(F.sum("c.changed_n").alias("n"), *part).collect():
        counts[row.j] += row.n
        sums[row.j] = [s + int(row[f"s{i}"]) for i, s in enumerate(sums[row.j])]


def _distances(dims: int, centers: np.ndarray):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                x = np.asarray(batch.column("x")[r].values, dtype=np.int64).reshape(-1, dims)
                own = np.asarray(batch.column("own")[r].values)
                step = x - centers[own]
                yield pa.record_batch([batch.column("ids")[r].values, pa.array(own, pa.int32()),
                                       pa.array((step * step).sum(1))], names=["id", "cluster", "distance"])

    return measure


def cluster(spark: SparkSession, vectors: DataFrame, centers: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, list[int]]:
    """``rounds`` of assignment and means over ``vectors`` (id, v), and one more assignment.

    Answers ``(id, cluster, distance)`` of every vector, the final centroids,
    and how many vectors each pass compared with all centroids.
    """
    k, dims = centers.shape
    drift, scanned = np.zeros(k), []
    sums, counts = [[0] * dims for _ in range(k)], [0] * k
    call = uuid.uuid4().hex
    state = B.scratch_table(spark, vectors.select("id", "v").mapInArrow(_pack, _VECTORS), "cluster-vectors")
    for t in range(rounds + 1):
        with B.owned_scratch(spark, f"cluster-{call}-{t % 2}"):  # the table before the last goes
            state = B.scratch_table(spark, state.mapInArrow(_pass(dims, centers, drift), _STATE), "cluster-state")
        scanned.append(state.agg(F.sum("rescanned")).first()[0] or 0)
        if t == rounds:
            break
        _sum_changes(state, dims, sums, counts)
        new = np.array([[s // n for s in sums[j]] if (n := counts[j]) else centers[j].tolist() for j in range(k)], np.int64)
        step = np.sqrt(((new - centers).astype(np.float64) ** 2).sum(1))
        other = np.array([np.delete(step, j).max(initial=0.0) for j in range(k)])
        drift = drift + (step + other) * (1 + SLACK) + SLACK
        centers = new
    return state.select("x", "own", "ids").mapInArrow(_distances(dims, centers), "id long, cluster int, distance long"), centers, scanned


_CENTERS = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("centroid_sha256", T.StringType())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 components in 40 clusters after 5 rounds."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    vectors = integer_vectors(table)
    start = first_centroids(vectors)
    if not len(start):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long,"
                                         " centroid_sha256 string")
    found, centers, _ = cluster(spark, vectors, start)
    found = B.scratch_table(spark, found, "clusters")
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centers.tolist())]
    # at most a row for each centroid, on both sides
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = found.groupBy("cluster").agg(exact.alias("_sum"))
    per = per.join(spark.createDataFrame(digests, _CENTERS), "cluster").crossJoin(per.agg(F.sum("_sum").alias("_all")))
    per = per.select("cluster", F.expr("try_cast(_sum AS long)").alias("cluster_inertia"),
                     F.expr("try_cast(_all AS long)").alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(per), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(rounds: int = ROUNDS, k: int = K) -> str:
    """The same in SQL, round by round."""
    def assigned(t: int) -> str:
        return f"""
a{t} AS MATERIALIZED (SELECT r, vec_id, v, min_by(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT r, vec_id, v, c, list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (v[i] - m[i]) * (v[i] - m[i]))) AS d
        FROM x, c{t}) GROUP BY r, vec_id, v)"""

    def moved(t: int) -> str:
        return f"""
s{t} AS (SELECT c, i, CAST(sum(v[i]) AS HUGEINT) AS s, count(*) AS n FROM a{t}, unnest(range(1, {DIMS + 1})) AS u(i) GROUP BY c, i),
n{t} AS (SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{t} GROUP BY c),
c{t + 1} AS MATERIALIZED (SELECT c, coalesce(n{t}.m, c{t}.m) AS m FROM c{t} LEFT JOIN n{t} USING (c))"""

    steps = ",".join(assigned(t) + ("," + moved(t) if t < rounds else "") for t in range(rounds + 1))
    return f"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda e: isfinite(e))) = {DIMS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m
  FROM (SELECT sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h, v FROM x ORDER BY h, v LIMIT {k})),{steps}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)
"""


ORACLE = oracle()
