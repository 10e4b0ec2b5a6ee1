"""Language-model scores by Katz backoff.

Order 1 is a Good-Turing discounted unigram model over the training words and
one class of unknown words.  In order k a seen word follows its context of
k - 1 words with its discounted relative frequency; what the discounts leave,
the context's backoff weight shares out over the unseen words in proportion
to order k - 1.  The weight is the left mass over one minus the lower-order
mass of the seen words, summed exactly over them, so each context sums to 1.
Where a context has no count low enough to be discounted, it gives up
1 / (count + 1) of its mass.

Each order is one exchange.  Blocks of documents send their distinct n-grams,
with counts and lower-order probabilities, to buckets by context; a frequent
context is dealt over several buckets by its n-grams.  Buckets sum counts and
contexts and write what each block asked for into the order's table, and
blocks go on with it.  A block names an n-gram once, so frequent n-grams do
not load a bucket; contexts above HOT tokens (at most 2**20 of them, by the
choice of HOT) are summed apart and handed to all tasks.  N-grams are told
apart by 64-bit hashes (48 bits within a context).

Cases: a null or empty text is one end token; without training tokens every
token has probability 1; null doc_ids are scored and not learned from;
repeated rows are learned and scored each; empty tables give no rows; input
columns other than id and text are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.llm import blocks as B
from issuelens.llm import tokens as K

FOLDS = 10
ORDER = 2
#: Counts up to this are discounted.
CUT = 5
#: Contexts of more tokens than this (and than 2**-20 of all) are dealt over several buckets.
HOT = 200_000
BASE_SHARE = 0.1
_BEGIN, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_ODD = np.uint64(0xA24BAED4963EE407)


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing factors of counts 0 to CUT + 1 (0: 0, above CUT: 1) from counts of counts 1 to CUT + 1.

    Where these cannot be had (a count of counts of 0, or a factor outside
    (0, 1)), half a count is taken off each.
    """
    half = [(r - 0.5) / r for r in range(1, CUT + 1)]
    d = half
    if all(x > 0 for x in n[:CUT + 1]):
        tail = (CUT + 1) * n[CUT] / n[0]
        if tail != 1:
            good = [((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail) for r in range(1, CUT + 1)]
            if all(0 < x < 1 for x in good):
                d = good
    return np.array([0.0, *d, 1.0])


class Order:
    """What scoring needs of one order beside the replies: discounts, totals and the hot contexts."""

    def __init__(self, n: list[int], total: int, distinct: int, hot: dict[int, tuple] | None = None):
        self.d, self.n, self.total, self.distinct = discounts(n), n, total, distinct
        hot = hot or {}
        self.hot = np.array(sorted(hot), np.uint64)
        rows = [hot[int(x)] for x in self.hot]
        self.hot_count = np.array([r[0] for r in rows], np.float64)
        self.hot_lower = np.array([r[1] for r in rows], np.float64)
        self.hot_seen = np.array([r[2] for r in rows], np.float64).reshape(-1, CUT)

    def left(self, count: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Mass that contexts leave to unseen words; ``seen`` has their numbers of words of count 1 to CUT."""
        r = np.arange(1, CUT + 1)
        low = (seen * r * (1 - self.d[1:CUT + 1])).sum(-1)
        return np.where(low > 0, low / np.maximum(count, 1), 1 / (count + 1))

    def discounted(self, c: np.ndarray, count: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Probability of seen words; ``low`` tells contexts that have counts to discount."""
        kept = self.d[np.minimum(c, CUT + 1)]
        return np.where(low, kept, count / (count + 1)) * c / np.maximum(count, 1)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(c))
        seen = np.array(self.n[:CUT], np.float64)
        total = np.float64(self.total)
        return np.where(c > 0, self.discounted(c, total, seen.any()), self.left(total, seen))


class Tokens:
    """A block's tokens (words and ends) and, per order, its distinct n-grams."""

    def __init__(self, data: bytes):
        self.table = B.decode(data)
        buf, off = K.buffers(self.table.column("text"))
        w = K.words(buf, off, lower=True)
        docs = w.n_docs
        doc = np.arange(docs)
        self.first = w.first + np.arange(docs + 1)
        self.hash = np.empty(len(w.hash) + docs, np.uint64)
        self.hash[np.arange(len(w.hash)) + w.doc_of()] = w.hash
        self.hash[self.first[1:] - 1] = _END
        self.place = np.arange(len(self.hash)) - np.repeat(self.first[:-1], np.diff(self.first))
        train = self.table.column("train").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        self.train = np.repeat(train[doc], np.diff(self.first))

    def before(self, j: int) -> np.ndarray:
        """The token j places before each, or the begin mark."""
        out = np.full(len(self.hash), _BEGIN, np.uint64)
        inside = self.place >= j
        out[inside] = self.hash[np.flatnonzero(inside) - j]
        return out

    def contexts(self, k: int) -> np.ndarray:
        h = np.full(len(self.hash), k, np.uint64)
        for j in range(k - 1, 0, -1):
            h = h * K.BASE + self.before(j)
        return K.mix(h)


class Grams:
    """Distinct n-grams of a block in the order of their buckets."""

    def __init__(self, t: Tokens, k: int, buckets: int, hot: int, count_below: np.ndarray | None, starts: int):
        if k == 1:
            part, tail = t.hash, np.zeros(len(t.hash), np.uint64)
            self.context = None
        else:
            context = t.contexts(k)
            gram = K.mix(context * K.BASE + t.hash)
            times = np.full(len(t.hash), starts, np.int64)
            inside = t.place > 0
            times[inside] = count_below[np.flatnonzero(inside) - 1]
            parts = np.maximum(1, -(-times // hot)).astype(np.uint64)
            salt = (gram & np.uint64(0xFFFF)) % parts
            part = np.where(parts > 1, K.mix(context + (salt + np.uint64(1)) * _ODD), context)
            tail = gram >> np.uint64(16)
        order = np.lexsort((tail, part)) if k > 1 else np.argsort(part, kind="stable")
        part_s, tail_s = part[order], tail[order]
        new = np.ones(len(order), bool)
        new[1:] = (part_s[1:] != part_s[:-1]) | (tail_s[1:] != tail_s[:-1])
        at = np.flatnonzero(new)
        self.some = order[at]                      # a position of each n-gram
        self.of = np.empty(len(order), np.int64)   # the n-gram of each position
        self.of[order] = np.cumsum(new) - 1
        self.part, self.tail = part_s[at], tail_s[at]
        self.count = np.bincount(self.of, weights=t.train, minlength=len(at)).astype(np.uint32)
        new = np.ones(len(at), bool)
        new[1:] = self.part[1:] != self.part[:-1]
        self.part_at = np.flatnonzero(new)         # the first n-gram of each context part
        self.part_of = np.cumsum(new) - 1
        self.cuts = list(B.bucket_cuts(self.part, buckets))
        if k > 1:
            self.context = context[self.some[self.part_at]]
            self.hot = (parts > 1)[self.some[self.part_at]]


_SENT = pa.schema([("bucket", pa.int64()), ("_block", pa.int64()), ("parts", pa.binary()), ("sizes", pa.binary()),
                   ("tails", pa.binary()), ("counts", pa.binary()), ("lower", pa.binary()), ("hot", pa.binary()),
                   ("contexts", pa.binary())])
_SENT_DDL = ("bucket long, _block long, parts binary, sizes binary, tails binary, counts binary, lower binary, "
             "hot binary, contexts binary")


def _send(block: int, g: Grams, lower: np.ndarray | None) -> pa.Table:
    rows = []
    for b, lo, hi in g.cuts:
        a, z = g.part_of[lo], g.part_of[hi - 1] + 1
        at = g.part_at[a:z]
        row = {"bucket": b, "_block": block, "parts": B.pack(g.part[at]), "counts": B.pack(g.count[lo:hi])}
        if lower is not None:
            hot = g.hot[a:z]
            row |= {"sizes": B.pack(np.diff(np.append(at, hi)).astype(np.uint32)), "tails": B.pack(g.tail[lo:hi]),
                    "lower": B.pack_coded(lower[g.some[lo:hi]]), "hot": B.pack(hot.astype(np.uint8)),
                    "contexts": B.pack(g.context[a:z][hot])}
        rows.append(row)
    return pa.Table.from_pylist(rows, schema=_SENT)


_REPLY = pa.schema([("kind", pa.int32()), ("_block", pa.int64()), ("bucket", pa.int64()), ("counts", pa.binary()),
                    ("totals", pa.binary()), ("low", pa.binary()), ("mass", pa.binary()), ("seen", pa.binary()),
                    ("context", pa.int64()), ("total", pa.int64()), ("lower", pa.float64()),
                    ("stats", pa.list_(pa.int64()))])
_REPLY_DDL = ("kind int, _block long, bucket long, counts binary, totals binary, low binary, mass binary, seen binary, "
              "context long, total long, lower double, stats array<long>")
_ANSWER, _STATS, _HOT = 0, 1, 2


def _counts_of_counts(total: np.ndarray) -> list[int]:
    n = np.bincount(np.minimum(total, CUT + 2), minlength=CUT + 3)
    return [*n[1:CUT + 2].tolist(), int(total.sum()), int((total > 0).sum())]


def _reduce(table: pa.Table) -> pa.Table:
    """A bucket's sums, and each block's answer in the order of its own n-grams."""
    rows = table.to_pylist()
    bucket = rows[0]["bucket"]
    first_order = rows[0]["sizes"] is None
    parts = [B.unpack(r["parts"], np.uint64) for r in rows]
    counts = [B.unpack(r["counts"], np.uint32) for r in rows]
    sizes = [np.ones(len(p), np.uint32) if first_order else B.unpack(r["sizes"], np.uint32) for p, r in zip(parts, rows)]
    ends = np.cumsum([0, *map(len, counts)])
    part = np.concatenate([np.repeat(p, s) for p, s in zip(parts, sizes)])
    if first_order:
        order = np.argsort(part, kind="stable")
        tail = None
    else:
        tail = np.concatenate([B.unpack(r["tails"], np.uint64) for r in rows])
        order = np.lexsort((tail, part))
    part_s = part[order]
    new_part = np.ones(len(order), bool)
    new_part[1:] = part_s[1:] != part_s[:-1]
    new = new_part.copy()
    if tail is not None:
        tail = tail[order]
        new[1:] |= tail[1:] != tail[:-1]
    at = np.flatnonzero(new)
    total = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), at)
    each = np.empty(len(order), np.int64)
    each[order] = total[np.cumsum(new) - 1]
    out = [{"kind": _STATS, "bucket": bucket, "stats": _counts_of_counts(total)}]
    if first_order:
        for r, lo, hi in zip(rows, ends[:-1], ends[1:]):
            out.append({"kind": _ANSWER, "_block": r["_block"], "bucket": bucket,
                        "counts": B.pack(each[lo:hi].astype(np.uint64))})
        return pa.Table.from_pylist(out, schema=_REPLY)
    lower = np.concatenate([B.unpack_coded(r["lower"], np.float64) for r in rows])[order][at]
    ctx_at = np.flatnonzero(new_part[at])
    ctx = part_s[at][ctx_at]
    ctx_total = np.add.reduceat(total, ctx_at)
    ctx_lower = np.add.reduceat(np.where(total > 0, lower, 0.0), ctx_at)
    ctx_seen = np.stack([np.add.reduceat((total == r).astype(np.int64), ctx_at) for r in range(1, CUT + 1)], 1)
    low = ctx_seen.any(1)
    told: set[int] = set()
    for r, p, s, lo, hi in zip(rows, parts, sizes, ends[:-1], ends[1:]):
        k = np.searchsorted(ctx, p)
        c = each[lo:hi]
        starts = np.concatenate([[0], np.cumsum(s)[:-1]]).astype(np.int64)
        unseen = np.minimum.reduceat(c, starts) == 0
        out.append({"kind": _ANSWER, "_block": r["_block"], "bucket": bucket, "counts": B.pack(c.astype(np.uint64)),
                    "totals": B.pack(ctx_total[k].astype(np.uint64)), "low": B.pack(low[k].astype(np.uint8)),
                    "mass": B.pack(ctx_lower[k[unseen]]), "seen": B.pack(ctx_seen[k[unseen]].astype(np.uint32).ravel())})
        hot = B.unpack(r["hot"], np.uint8).astype(bool)
        for i, h in zip(k[hot].tolist(), B.unpack(r["contexts"], np.uint64).view(np.int64).tolist()):
            if i not in told:
                told.add(i)
                out.append({"kind": _HOT, "bucket": bucket, "context": h, "total": int(ctx_total[i]),
                            "lower": float(ctx_lower[i]), "stats": ctx_seen[i].tolist()})
    return pa.Table.from_pylist(out, schema=_REPLY)


def _probabilities(t: Tokens, g: Grams, k: int, order: Order, replies: list[dict], lower: np.ndarray | None):
    """Counts and probabilities of order k of the block's positions."""
    replies = sorted(replies, key=lambda r: r["bucket"])
    got = [B.unpack(r["counts"], np.uint64) for r in replies]
    c = np.concatenate(got).astype(np.int64) if got else np.zeros(0, np.int64)
    if k == 1:
        return c[g.of], order.unigram(c)[g.of]
    total = np.concatenate([B.unpack(r["totals"], np.uint64) for r in replies]).astype(np.float64)
    low = np.concatenate([B.unpack(r["low"], np.uint8) for r in replies]).astype(bool)
    unseen = np.minimum.reduceat(c, g.part_at) == 0
    mass, seen = np.zeros(len(total)), np.zeros((len(total), CUT))
    mass[unseen] = np.concatenate([B.unpack(r["mass"], np.float64) for r in replies])
    seen[unseen] = np.concatenate([B.unpack(r["seen"], np.uint32) for r in replies]).reshape(-1, CUT)
    if g.hot.any():
        at = np.searchsorted(order.hot, g.context[g.hot])
        total[g.hot], mass[g.hot] = order.hot_count[at], order.hot_lower[at]
        seen[g.hot], low[g.hot] = order.hot_seen[at], order.hot_seen[at].any(1)
    weight = np.where(total > 0, order.left(total, seen) / np.maximum(1 - mass, 1e-12), 1.0)
    p = order.discounted(c, total[g.part_of], low[g.part_of])
    return c[g.of], np.where(c[g.of] > 0, p[g.of], weight[g.part_of][g.of] * lower)


class Plan:
    """The orders known so far, for tasks."""

    def __init__(self, buckets: int, orders: list[Order]):
        self.buckets, self.orders = buckets, orders
        self.hot = max(HOT, (orders[0].total if orders else 0) >> 20)

    def climb(self, t: Tokens, replies: dict[int, list[dict]], ends: int):
        """Counts of order 1, and counts and probabilities of the last known order."""
        c = p = c1 = None
        for k, order in enumerate(self.orders, 1):
            g = Grams(t, k, self.buckets, self.hot, c, ends)
            c, p = _probabilities(t, g, k, order, replies.get(k, []), p)
            c1 = c if k == 1 else c1
        return c1, c, p


def _by_order(right: pa.Table) -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {}
    for r in right.to_pylist():
        out.setdefault(r["order"], []).append(r)
    return out


def _send_words(plan):
    def send(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                g = Grams(Tokens(data.as_py()), 1, plan.value.buckets, 1, None, 0)
                yield from _send(block, g, None).to_batches()
    return send


def _send_grams(plan, k: int, ends: int):
    def send(left, right):
        t = Tokens(left.column("_data")[0].as_py())
        _, c, p = plan.value.climb(t, _by_order(right), ends)
        return _send(left.column("_block")[0].as_py(), Grams(t, k, plan.value.buckets, plan.value.hot, c, ends), p)
    return send


def _score(plan, ends: int):
    def final(left, right):
        t = Tokens(left.column("_data")[0].as_py())
        c, _, p = plan.value.climb(t, _by_order(right), ends)
        one = plan.value.orders[0]
        base = (c + BASE_SHARE) / (one.total + BASE_SHARE * (one.distinct + 1))
        at = t.first[:-1]
        return pa.Table.from_arrays(
            [t.table.column("id"), pa.array(np.diff(t.first)), pa.array(np.add.reduceat((c > 0).astype(np.int64), at)),
             pa.array(np.full(len(at), one.total)), pa.array(np.add.reduceat(np.log10(base), at)),
             pa.array(np.add.reduceat(np.log10(p), at))],
            names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return final


def _bucketed(spark: SparkSession, blocks: DataFrame, source: DataFrame) -> DataFrame:
    """Blocks as a written table bucketed by block, so that no later step moves them again."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(max(partitions, total // B.BLOCK_BYTES), 100_000)
    name = f"katz_blocks_{uuid.uuid4().hex[:12]}"
    (blocks.write.format("parquet").option("path", B.new_scratch(spark, name))
     .bucketBy(n, "_block").sortBy("_block").saveAsTable(name))
    return spark.table(name)


def score(spark: SparkSession, docs: DataFrame, train: Column, id_col: str = "doc_id", text: str = "text",
          order: int = ORDER) -> DataFrame:
    """Every text's ``(id, n_tokens, n_known, train_tokens, base_score, score)`` by the texts where ``train`` holds."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    kind = rows.schema["id"].dataType.simpleString()
    packed = _bucketed(spark, B.pack_blocks(rows, "text"), rows)
    buckets = B.n_buckets(packed)
    blocks = packed.select("_block", "_data").groupBy("_block")
    replies: list[DataFrame] = []
    orders: list[Order] = []
    ends = 0

    def told() -> DataFrame:
        out = None
        for k, r in enumerate(replies, 1):
            r = r.where(F.col("kind") == _ANSWER).select("_block", F.lit(k).alias("order"), "bucket", "counts", "totals",
                                                         "low", "mass", "seen")
            out = r if out is None else out.union(r)
        return out

    for k in range(1, order + 1):
        plan = spark.sparkContext.broadcast(Plan(buckets, list(orders)))
        if k == 1:
            sent = packed.select("_block", "_data").mapInArrow(_send_words(plan), _SENT_DDL)
        else:
            sent = blocks.cogroup(told().groupBy("_block")).applyInArrow(_send_grams(plan, k, ends), _SENT_DDL)
        table = B.scratch_table(spark, sent.groupBy("bucket").applyInArrow(_reduce, _REPLY_DDL), f"katz-{k}")
        replies.append(table)
        s = table.where(F.col("kind") == _STATS).agg(*(F.sum(F.col("stats")[i]) for i in range(CUT + 3))).first()
        s = [x or 0 for x in s]
        hot = table.where(F.col("kind") == _HOT).groupBy("context").agg(
            F.sum("total"), F.sum("lower"), F.array(*(F.sum(F.col("stats")[i]) for i in range(CUT)))).collect()
        orders.append(Order(s[:CUT + 1], s[CUT + 1], s[CUT + 2],
                            {r[0] & (1 << 64) - 1: (r[1], r[2], r[3]) for r in hot}))
        if k == 1:
            ends = rows.where("train").count()

    plan = spark.sparkContext.broadcast(Plan(buckets, orders))
    return (blocks.cogroup(told().groupBy("_block")).applyInArrow(
        _score(plan, ends), f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        .withColumnRenamed("id", id_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by a model of those outside fold 0 of doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    scored = score(spark, docs, fold != 0)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")
