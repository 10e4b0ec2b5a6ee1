"""Substring dedup: Rabin-Karp hashes of every window, counted in Spark.

Every window of ``size`` words of every document is hashed (64 bits, over
64-bit word hashes).  A block sends its distinct window hashes, each with the
block's smallest doc_id that has it, to hash buckets; a bucket finds hashes
that several blocks have and answers each block whose smallest id is not the
smallest of all.  A window whose hash occurs under a smaller doc_id is
repeated; overlapping repeated windows merge into maximal removal intervals.

Cases: a null text has no words; a document of fewer than ``size`` words
keeps all; a null doc_id counts as larger than every id; rows of equal
doc_id do not remove each other's words; an empty table gives an empty one.
Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.llm import blocks as B
from issuelens.llm import tokens as K

WINDOW = 13
_NO_ID = np.iinfo(np.int64).max
RESULT = ("n_words", "n_removed", "kept_sha256", "removed")


def _ids(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).combine_chunks().cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _block_keys(table: pa.Table, id_col: str, text: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct window hashes of a block, ascending, each with its smallest doc_id."""
    ids = _ids(table, id_col)
    hashes, owners = [], []
    for lo, _, data, off in K.text_slices(table.column(text)):
        w = K.words(data, off)
        at, h = K.windows(w, size)
        hashes.append(h)
        owners.append(ids[lo + w.doc_of()[at]])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, own = np.concatenate(hashes), np.concatenate(owners)
    del hashes, owners
    order = np.argsort(h, kind="stable")
    h, own = h[order], own[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.minimum.reduceat(own, first) if len(h) else own


def _send(id_col: str, text: str, size: int, buckets: int):
    def send(batches):
        for batch in batches:
            for block, data in zip(batch.column("_block").to_pylist(), batch.column("_data")):
                keys, own = _block_keys(B.decode(data.as_py()), id_col, text, size)
                rows = {"bucket": [], "_block": [], "keys": [], "ids": []}
                for b, lo, hi in B.bucket_cuts(keys, buckets):
                    for k, v in zip(rows, (b, block, B.pack(keys[lo:hi]), B.pack_coded(own[lo:hi]))):
                        rows[k].append(v)
                if rows["bucket"]:
                    yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(
                        [("bucket", pa.int64()), ("_block", pa.int64()), ("keys", pa.binary()),
                         ("ids", pa.binary())]))
        K.give_back()
    return send


_ANSWER = pa.schema([("_block", pa.int64()), ("keys", pa.binary()), ("smallest", pa.binary())])


def _answer(table: pa.Table) -> pa.Table:
    """For one bucket: per block, the hashes that another block has under a smaller doc_id."""
    keys, own, src = [], [], []
    K.give_back()
    blocks = table.column("_block").to_pylist()
    for n in range(len(blocks)):
        k = B.unpack(table.column("keys")[n].as_py(), np.uint64)
        keys.append(k)
        own.append(B.unpack_coded(table.column("ids")[n].as_py(), np.int64))
        src.append(np.full(len(k), n, np.int32))
    k = np.concatenate(keys)
    del keys
    own, src = np.concatenate(own), np.concatenate(src)
    order = np.argsort(k, kind="stable")
    k = k[order]
    same = k[1:] == k[:-1]
    shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    k, own, src = k[shared], own[order][shared], src[order][shared]
    if not len(k):
        return _ANSWER.empty_table()
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    smallest = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(k))))
    late = smallest < own
    k, smallest, src = k[late], smallest[late], src[late]
    order = np.argsort(src, kind="stable")
    k, smallest, src = k[order], smallest[order], src[order]
    at = np.concatenate([[0], np.flatnonzero(np.diff(src)) + 1, [len(src)]]) if len(src) else np.zeros(1, int)
    out = {"_block": [], "keys": [], "smallest": []}
    for lo, hi in zip(at[:-1], at[1:]):
        out["_block"].append(blocks[src[lo]])
        out["keys"].append(B.pack(k[lo:hi]))
        out["smallest"].append(B.pack(smallest[lo:hi]))
    return pa.Table.from_pydict(out, schema=_ANSWER)


def _cut(table: pa.Table, id_col: str, text: str, size: int, known: np.ndarray, smallest: np.ndarray):
    """Per document of a block: word count, removal intervals (words), kept text, digest of kept words."""
    ids = _ids(table, id_col)
    keys, own = _block_keys(table, id_col, text, size)
    if len(known):
        at = np.searchsorted(keys, known)
        own[at] = np.minimum(own[at], smallest)
    texts = table.column(text)
    for lo, hi, data, off in K.text_slices(texts):
        w = K.words(data, off)
        at, h = K.windows(w, size)
        hit = at[own[np.searchsorted(keys, h)] < ids[lo + w.doc_of()[at]]] if len(h) else at
        step = np.zeros(len(w.start) + 1, np.int32)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + size, -1)
        gone = np.cumsum(step)[:-1] > 0
        removed = np.add.reduceat(np.append(gone, False), np.minimum(w.first[:-1], len(gone)), dtype=np.int64)
        removed[w.counts == 0] = 0
        for d in range(hi - lo):
            a, z = int(w.first[d]), int(w.first[d + 1])
            raw = data[off[d]:off[d + 1]].tobytes()
            if not removed[d]:
                yield z - a, 0, [], texts[lo + d].as_py(), hashlib.sha256(b" ".join(raw.split())).hexdigest()
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[a:z], [False]]).astype(np.int8)))
            parts, pos = [], 0
            for s, e in zip(edge[::2], edge[1::2]):
                parts.append(raw[pos:w.start[a + s] - off[d]])
                pos = int(w.start[a + e] - off[d]) if a + e < z else len(raw)
            kept = b"".join([*parts, raw[pos:]])
            yield (z - a, int(removed[d]), [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2])],
                   kept.decode(), hashlib.sha256(b" ".join(kept.split())).hexdigest())


def substring_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = WINDOW,
                    block_bytes: int = B.BLOCK_BYTES, bucket_keys: int = B.BUCKET_KEYS) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``.

    Adds n_words and n_removed (words before, and words removed), removed
    (maximal intervals of word positions) and kept_sha256 (of the kept words
    joined by one space).  A text that loses nothing stays as it is; from
    others the removed words go with the white space after them.  A task holds
    a block of ``block_bytes`` of text, or ``bucket_keys`` window hashes.
    """
    docs = docs.drop(*RESULT)
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(
        "n_words long, n_removed long, kept_sha256 string, "
        "removed array<struct<start:int,end:int>>").fields])
    blocks = B.write_blocks(spark, docs, text, "substring-blocks", block_bytes)
    buckets = B.n_buckets(blocks, keys=bucket_keys)
    sent = blocks.mapInArrow(_send(id_col, text, size, buckets),
                             "bucket long, _block long, keys binary, ids binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "_block long, keys binary, smallest binary")

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        known = [B.unpack(x.as_py(), np.uint64) for x in right.column("keys")]
        small = [B.unpack(x.as_py(), np.int64) for x in right.column("smallest")]
        known = np.concatenate(known) if known else np.zeros(0, np.uint64)
        small = np.concatenate(small) if small else np.zeros(0, np.int64)
        K.give_back()
        table = B.decode(left.column("_data")[0].as_py())
        rows = list(_cut(table, id_col, text, size, known, small))
        k = table.schema.get_field_index(text)
        table = table.set_column(k, text, pa.array([r[3] for r in rows], pa.string()))
        for name, i, kind in (("n_words", 0, pa.int64()), ("n_removed", 1, pa.int64()),
                              ("kept_sha256", 4, pa.string()),
                              ("removed", 2, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))):
            table = table.append_column(name, pa.array([r[i] for r in rows], kind))
        return table

    return (blocks.select("_block", "_data").groupBy("_block")
            .cogroup(answers.groupBy("_block")).applyInArrow(cut, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: repeated 13-word windows removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(spark, docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
p AS (SELECT doc_id, len(ws) AS n_words, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
g AS (SELECT w.doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS win
      FROM w, unnest(range(1, len(ws) - 11)) AS t(i)),
m AS (SELECT win, min(doc_id) AS least FROM g GROUP BY win),
hit AS (SELECT DISTINCT g.doc_id, g.i + k AS i
        FROM g JOIN m USING (win), unnest(range(0, 13)) AS u(k) WHERE m.least < g.doc_id),
kept AS (SELECT p.doc_id, count(*) FILTER (hit.i IS NOT NULL) AS n_removed,
                string_agg(p.word, ' ' ORDER BY p.i) FILTER (hit.i IS NULL) AS body
         FROM p LEFT JOIN hit ON p.doc_id = hit.doc_id AND p.i = hit.i GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
