"""Blocks of documents, and packed keys that travel between blocks and buckets.

Corpus-wide counting of window or n-gram hashes moves one key per token.  As
rows these cost tens of bytes each; here a block of documents (a few MB of
text) sends one row per bucket, with its distinct keys sorted and packed.
Each key occurs once per block in a bucket, however often the corpus has it,
so no bucket grows with a frequent passage.  Answers go back per block.

Blocks are a written table: a block keeps its number whatever executor is
lost later, and later passes start from the table, not from the source.
"""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.llm.tokens import give_back
from issuelens.session import scratch_path

#: Text bytes of a block; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: Documents of a block at most.
BLOCK_DOCS = 65_000
#: Keys that one bucket's task sorts at once.
BUCKET_KEYS = 2_000_000

_BLOCK_SCHEMA = "_block long, _bytes long, _data binary"
_ZSTD = pa.Codec("zstd", compression_level=1)


#: Ids of which so many at most are broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
_MADE: dict[tuple[str, str], list[str]] = {}
_OWNER: list[str] = []
#: Paths of scratch tables by the DataFrame that reads them.
_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def scratch_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here."""
    path = new_scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more (what was made of them is written)."""
    for table in tables:
        made, path = _PATHS.pop(id(table), (None, ""))
        if made is not None and made() is table:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def new_scratch(spark: SparkSession, name: str) -> str:
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    if _OWNER:
        _MADE.setdefault((spark.sparkContext.applicationId, _OWNER[-1]), []).append(path)
    return path


@contextmanager
def owned_scratch(spark: SparkSession, owner: str):
    """Scratch tables made inside belong to ``owner``; those of its last use are deleted first.

    For work in steps whose results are written before the next step begins.
    """
    for path in _MADE.pop((spark.sparkContext.applicationId, owner), []):
        _delete(spark, path)
    _OWNER.append(owner)
    try:
        yield
    finally:
        _OWNER.pop()


def join_ids(rows: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """Semi or anti join by ids: few of them, by their count, are broadcast, so that the rows need not move."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, column, how)


def _encode(batch: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=_ZSTD)) as w:
        w.write_table(batch.combine_chunks())
    return sink.getvalue().to_pybytes()


def decode(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def write_blocks(spark: SparkSession, docs: DataFrame, text: str, name: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` as a written table of blocks ``(_block, _bytes, _data)``; all columns are kept."""
    return scratch_table(spark, pack_blocks(docs, text, block_bytes), name)


def pack_blocks(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks that are numbered by partition: write them before anything refers to the numbers."""
    column = docs.columns.index(text)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        held: list[pa.Table] = []
        size = rows = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, rows, seq
            out = pa.record_batch([pa.array([(task << 32) | seq], pa.int64()), pa.array([size], pa.int64()),
                                   pa.array([_encode(pa.concat_tables(held))], pa.binary())],
                                  names=["_block", "_bytes", "_data"])
            held, size, rows, seq = [], 0, 0, seq + 1
            return out

        for batch in batches:
            table = pa.Table.from_batches([batch])
            lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(table.column(column)), 0)
                                 .combine_chunks(), dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            lo = 0
            while lo < len(lengths):
                hi = int(np.searchsorted(ends, ends[lo] + block_bytes - size, side="right")) - 1
                hi = min(max(hi, lo + (not held)), lo + BLOCK_DOCS - rows, len(lengths))
                if hi > lo:
                    held.append(table.slice(lo, hi - lo))
                    size += int(ends[hi] - ends[lo])
                    rows += hi - lo
                if hi < len(lengths):
                    yield flush()
                lo = hi
        if held:
            yield flush()
        give_back()

    return docs.mapInArrow(pack, _BLOCK_SCHEMA)


def n_buckets(blocks: DataFrame, bytes_per_key: int = 6, keys: int = BUCKET_KEYS) -> int:
    """Buckets that hold ``keys`` keys each, if every ``bytes_per_key`` bytes of text make one."""
    total = blocks.agg(F.sum("_bytes")).first()[0] or 0
    return max(1, -(-total // (bytes_per_key * keys)))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending keys give ascending buckets (the high 32 bits decide)."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def bucket_cuts(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """``(bucket, lo, hi)`` of ascending keys, for buckets that have some."""
    if not len(keys):
        return
    b = bucket_of(keys, buckets)
    at = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]])
    for lo, hi in zip(at[:-1], at[1:]):
        yield int(b[lo]), int(lo), int(hi)


def pack(a: np.ndarray) -> bytes:
    """An integer or float array, its bytes by plane and compressed: sorted or small numbers take few bytes."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if len(a) else b""
    body = _ZSTD.compress(planes, asbytes=True)
    return len(planes).to_bytes(8, "little") + body


def unpack(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    size = int.from_bytes(data[:8], "little")
    if not size:
        return np.zeros(0, dtype)
    planes = _ZSTD.decompress(pa.py_buffer(data)[8:], size, asbytes=True)
    flat = np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, -1).T
    return np.ascontiguousarray(flat).view(dtype).ravel()


def pack_coded(a: np.ndarray) -> bytes:
    """An array with few distinct values: these, and an index."""
    values, index = np.unique(a, return_inverse=True)
    head = pack(values)
    return len(head).to_bytes(8, "little") + head + pack(index.astype(np.uint32))


def unpack_coded(data: bytes, dtype) -> np.ndarray:
    cut = 8 + int.from_bytes(data[:8], "little")
    return unpack(data[8:cut], dtype)[unpack(data[cut:], np.uint32)]
