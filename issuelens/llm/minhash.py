"""MinHash near-dedup with bottom-k sketches of one hash function.

A document's set is its distinct shingles of ``size`` words; documents of
equal sets are one class.  A class keeps the k smallest of its shingle hashes
(a set of up to SMALL shingles keeps all: its sketch is the set).

Inverted lists of the retained values generate overlaps.  Values of one class
only make no list.  Of the rest a class takes part in the lists of its rarest
ones, as many as make it meet every class that shares the fewest values a
link can have: with whole sets ceil(3/4 n), with sketches MIN_SHARED of K
(at the similarity of 3/4 a link shares fewer with a chance below 1e-9).
A passage that many documents share thus makes no candidates unless it is
most of a document.

Lists are resolved without all their pairs: each class is first compared with
the most typical class of its lists (of most shared values), and linked ones
take its label.  Then, in lists of several labels, classes of different label
meet.  Lists hold no sets and are not joined to pairs: classes are dealt to
tiles of two blocks, and a class sends its set once to each tile where it may
meet another, not once to each pair.  There a pair is held, once, to the
estimate by the sketch of its union (whole sets: to the similarity itself),
and what passes to the full sets.

Cases: null or empty texts have n_shingles 0 and are their own component;
with fewer than ``size`` words the whole sequence is the one shingle; rows of
equal doc_id and different text are classed by text; a null doc_id is never
the smallest while there is another; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.llm import blocks as B
from issuelens.llm import tokens as K
from issuelens.llm.components import components

SIZE = 5
#: A link has 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Values of a sketch, and how many of the union's sketch a link shares: fewer than 24 of 64 with a chance of 5e-11 at 0.75.
K_LARGE = 64
MIN_SHARED = 24
#: Sets of up to this many shingles are kept whole.
SMALL = 192
#: A set that can link to one above SMALL is above this.
LARGE = SMALL * PERCENT // 100
#: Values of a block of classes, about; a tile holds the sets of two blocks.
TILE_VALUES = 1 << 19
#: Flipping it makes the order of signed numbers that of the hashes.
_SIGN = np.uint64(1 << 63)
_ODD = np.uint64(0xA24BAED4963EE407)


def shingle_sets(w: K.Words, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, document by document and ascending, and each document's first place."""
    at, h = K.windows(w, size)
    doc = np.searchsorted(w.first, at, side="right") - 1
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            live = w.counts[short] > k
            whole[live] = whole[live] * K.BASE + w.hash[w.first[short[live]] + k]
        doc = np.concatenate([doc, short])
        h = np.concatenate([h, K.mix(whole + w.counts[short].astype(np.uint64))])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(w.n_docs + 1))


def _lists(h: np.ndarray, first: np.ndarray, take: np.ndarray) -> pa.Array:
    """The first ``take`` values of each document; none: null."""
    inside = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first)) < np.repeat(take, np.diff(first))
    ends = np.concatenate([[0], np.cumsum(np.minimum(take, np.diff(first)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((h[inside] ^ _SIGN).view(np.int64)),
                                    mask=pa.array(take == 0))


def _class_of(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit print of each document's set."""
    total = np.add.reduceat(np.append(K.mix(h ^ _ODD), np.uint64(0)), first[:-1]) if len(first) > 1 else h[:0]
    return K.mix(total + np.diff(first).astype(np.uint64))


_SKETCH = "id long, print long, n_shingles long, cls long, small array<long>, large array<long>"


def _sketch(batches):
    for batch in batches:
        for lo, hi, data, off in K.text_slices(batch.column(1)):
            h, first = shingle_sets(K.words(data, off, lower=True))
            n = np.diff(first)
            print_of = _class_of(h, first)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(lo, hi - lo).cast(pa.int64()), batch.column(2).slice(lo, hi - lo), pa.array(n, pa.int64()),
                pa.array(print_of.view(np.int64), mask=n == 0),
                _lists(h, first, np.where(n <= SMALL, n, 0)),
                _lists(h, first, np.where(n > LARGE, K_LARGE, 0))],
                names=["id", "print", "n_shingles", "cls", "small", "large"])
    K.give_back()


def _sets(batches):
    """Whole sets of documents, by class."""
    for batch in batches:
        for lo, hi, data, off in K.text_slices(batch.column(0)):
            h, first = shingle_sets(K.words(data, off, lower=True))
            n = np.diff(first)
            print_of = _class_of(h, first)
            keep = n > 0
            lists = _lists(h, first, np.where(keep, n, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(print_of[keep].view(np.int64)), lists.filter(pa.array(keep))], names=["cls", "whole"])
    K.give_back()


def _enough(inter: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    return 100 * inter >= PERCENT * (n_a + n_b - inter)


def _estimate(of_a: np.ndarray, of_b: np.ndarray) -> np.ndarray:
    """Whether sketches (rows of ``of_b``) may link to the sketch ``of_a``, all ascending.

    The K_LARGE smallest values of both sketches are the sketch of the union;
    those of them that both sets have estimate the similarity.
    """
    rank = np.searchsorted(of_a, of_b)
    both = of_a[np.minimum(rank, len(of_a) - 1)] == of_b
    in_union = np.arange(of_b.shape[1]) + rank - (np.cumsum(both, axis=1) - both)
    return (both & (in_union < K_LARGE)).sum(axis=1) >= MIN_SHARED


class _Sets:
    """Whole sets of a tile's classes, ascending ranks in place of hashes."""

    def __init__(self, whole: pa.ListArray):
        self.values = np.unique(whole.flatten().to_numpy(), return_inverse=True)[1].astype(np.int32)
        self.n = np.asarray(whole.value_lengths(), np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.has = np.zeros(len(self.values), bool)

    def linked(self, one: int, others: np.ndarray, tier: np.ndarray) -> np.ndarray:
        """Whether ``one`` is linked with each of ``others``: in tier 1 the sketches have to agree first."""
        own = self.values[self.start[one]:self.start[one] + self.n[one]]
        good = np.ones(len(others), bool)
        if (by_sketch := tier == 1).any():
            good[by_sketch] = _estimate(own[:K_LARGE], self.values[self.start[others[by_sketch]][:, None] + np.arange(K_LARGE)])
        others = others[good]
        if len(others):
            size = self.n[others]
            ends = np.cumsum(size)
            self.has[own] = True
            inside = self.has[self.values[np.arange(ends[-1]) + np.repeat(self.start[others] - ends + size, size)]]
            self.has[own] = False
            good[good] = _enough(np.add.reduceat(inside, ends - size, dtype=np.int64), self.n[one], size)
        return good


def _verify(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """The links ``(a, b)`` among a tile's pairs ``(a, b, tier)``, by its sets ``(cls, whole)``."""
    cls, at = np.unique(sets.column("cls").to_numpy(), return_index=True)
    of = _Sets(sets.column("whole").combine_chunks().take(pa.array(at)))
    a, b, tier = (pairs.column(c).to_numpy() for c in ("a", "b", "tier"))
    order = np.argsort(a, kind="stable")
    a, b, tier = np.searchsorted(cls, a[order]), np.searchsorted(cls, b[order]), tier[order]
    good = np.zeros(len(a), bool)
    cuts = np.concatenate([np.flatnonzero(np.diff(a, prepend=-1)), [len(a)]])
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        good[lo:hi] = of.linked(a[lo], b[lo:hi], tier[lo:hi])
    K.give_back()
    return pa.table({"a": cls[a[good]], "b": cls[b[good]]})


def _meet(rows: pa.Table) -> pa.Table:
    """The links ``(a, b)`` between the two blocks of a tile, or within its one: classes of a common list and different roots.

    A row is a class in a tier; each pair is settled once, however many lists it has in common.
    """
    cls, tier, root, block = (rows.column(c).to_numpy() for c in ("cls", "tier", "root", "block"))
    of = _Sets(rows.column("whole").combine_chunks())
    open_ = rows.column("open").combine_chunks()
    length = np.asarray(open_.value_lengths(), np.int64)
    row = np.repeat(np.arange(len(cls)), length)
    value = np.unique(open_.flatten().to_numpy(), return_inverse=True)[1]
    order = np.argsort(value, kind="stable")
    listed = row[order]                                        # list by list, rows ascending
    ends = np.cumsum(np.bincount(value))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = np.cumsum(length) - length
    two = block.min() != block.max() if len(block) else False
    found = np.zeros(len(cls), bool)
    out_a, out_b = [cls[:0]], [cls[:0]]
    for i in range(len(cls)):
        mine = slice(first[i], first[i] + length[i])
        for lo, hi in zip(place[mine] + 1, ends[value[mine]]):  # what comes after this row in each of its lists
            found[listed[lo:hi]] = True
        other = i + 1 + np.flatnonzero(found[i + 1:])
        found[other] = False
        big, small = np.maximum(of.n[i], of.n[other]), np.minimum(of.n[i], of.n[other])
        fit = (tier[other] == tier[i]) & (root[other] != root[i]) & (cls[other] != cls[i]) & (100 * small >= PERCENT * big)
        fit &= ((block[other] != block[i]) | (not two)) & ((tier[i] == 0) | (big > SMALL))
        other = other[fit]
        if len(other):
            other = other[of.linked(i, other, tier[other])]
            out_a.append(np.full(len(other), cls[i]))
            out_b.append(cls[other])
    K.give_back()
    return pa.table({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})


def _sizes_allow(n_a: Column, n_b: Column) -> Column:
    """Two classes of a tier whose sizes allow a link; sketches are for pairs that the whole sets do not settle."""
    return (100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)) & (
        (F.col("tier") == 0) | (F.greatest(n_a, n_b) > SMALL))


def _members(classes: DataFrame) -> DataFrame:
    """``(cls, tier, n, typical, lists)`` of the classes that take part in inverted lists.

    ``lists`` are the values whose lists a class is in, the rarest of its
    shared ones; ``typical`` counts all of its values that others have.
    """
    def tier(number: int, column: str) -> DataFrame:
        return classes.where(F.col(column).isNotNull()).select(
            "cls", F.lit(number).alias("tier"), "n", F.explode(column).alias("value"))

    posted = tier(0, "small").union(tier(1, "large"))
    fewest = F.when(F.col("tier") == 0, F.ceil(F.col("n") * PERCENT / 100)).otherwise(MIN_SHARED)
    often = posted.groupBy("tier", "value").agg(F.count("*").alias("df")).where("df > 1")
    # dealt by class as plain rows: partial lists of mostly one value each would be larger, and the join below moves nothing again
    shared = posted.join(often, ["tier", "value"]).repartition("cls", "tier").groupBy("cls", "tier", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    return shared.where(F.size("v") >= fewest).select(
        "cls", "tier", "n", F.size("v").alias("typical"),
        F.slice("v.value", F.lit(1), (F.size("v") - fewest + 1).cast("int")).alias("lists"))


def _one_each(sketches: DataFrame, first: DataFrame) -> DataFrame:
    """``(cls, n, small, large)`` of the documents that stand for their classes: those of smallest key.

    Only classes of several documents, by their count few, need a look-up; the sketches need not move for it.
    """
    several = first.where("copies > 1").select("cls", F.col("rep").alias("least"))
    few = several.count() <= B.BROADCAST_IDS
    found = sketches.where("cls is not null").join(F.broadcast(several) if few else several, "cls", "left")
    return found.where("least is null or key = least").select("cls", F.col("n_shingles").alias("n"), "small", "large")


def _part(key: Column, values: Column) -> Column:
    """One of the parts, of about TILE_VALUES each, that so many values make."""
    return F.pmod(F.xxhash64(key), F.greatest(F.lit(1), F.ceil(values / TILE_VALUES)))


def _links(spark: SparkSession, pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """Of pairs (a, b, tier, tile) those that are links, settled tile by tile on the sets of its classes."""
    sent = pairs.select(F.col("tile").alias("to"), F.explode(F.array("a", "b")).alias("cls")).distinct()
    sent = sent.join(whole, "cls").select("to", "cls", "whole")
    links = pairs.groupBy("tile").cogroup(sent.groupBy("to")).applyInArrow(
        lambda left, right: _verify(left, right), "a long, b long")
    return B.scratch_table(spark, links, "links")


def _met(spark: SparkSession, open_: DataFrame, whole: DataFrame) -> DataFrame:
    """The links between classes (cls, tier, n, root, block, open) of common lists.

    A class goes to the tile of its block and another if one of its lists has a class there that may be news.
    """
    posts = open_.select("cls", "tier", "n", "root", "block", F.explode("open").alias("value"))
    there = posts.groupBy("tier", "value", F.col("block").alias("to")).agg(
        F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    news = ((F.col("lo") != F.col("root")) | (F.col("hi") != F.col("root"))) & (
        100 * F.col("n_hi") >= PERCENT * F.col("n")) & (100 * F.col("n") >= PERCENT * F.col("n_lo"))
    tile = F.xxhash64(F.least("block", "to"), F.greatest("block", "to"))
    sent = posts.join(there, ["tier", "value"]).where(news).select("cls", "tier", tile.alias("tile")).distinct()
    rows = open_.drop("n").join(whole, "cls").join(sent, ["cls", "tier"])
    return B.scratch_table(spark, rows.groupBy("tile").applyInArrow(_meet, "a long, b long"), "links")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every document.

    And ``cls``, its class of equal sets, ``root``, the class that stands for its
    component (both null without shingles), and ``print``, the xxhash64 of its
    text: with the id it tells rows apart where ids are null or repeat.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("print"))
    key = F.coalesce("id", F.lit((1 << 63) - 1))
    sketches = B.scratch_table(spark, texts.mapInArrow(_sketch, _SKETCH).withColumn("key", key), "sketches")
    rows = B.scratch_table(spark, sketches.select("id", "key", "print", "n_shingles", "cls"), "rows")
    first = rows.where("cls is not null").groupBy("cls").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    members = B.scratch_table(spark, _members(_one_each(sketches, first)), "members")
    B.forget(spark, sketches)
    ids = members.select("cls").distinct().join(first, "cls").select(F.col("rep").alias("id"))
    whole = B.scratch_table(
        spark, B.join_ids(texts.withColumn("id", key), ids, "id", "left_semi").select("text")
        .mapInArrow(_sets, "cls long, whole array<long>"), "sets")
    all_values = F.lit(members.agg(F.sum("n")).first()[0] or 0)

    # each class with the most typical one of its lists: in a group of copies mostly what they are copies of
    posts = members.select("cls", "tier", F.struct("typical", "n", "cls").alias("as"), F.explode("lists").alias("value"))
    hubs = posts.groupBy("tier", "value").agg(F.max("as").alias("hub"), F.min("as").alias("least")).where("least < hub")
    best = posts.join(hubs, ["tier", "value"]).groupBy("cls", "tier", F.col("as.n").alias("n")).agg(F.max("hub").alias("hub"))
    pairs = best.where((F.col("cls") != F.col("hub.cls")) & _sizes_allow(F.col("n"), F.col("hub.n"))).select(
        F.col("cls").alias("a"), F.col("hub.cls").alias("b"), "tier", "n")
    pairs = B.scratch_table(spark, pairs, "pairs")
    of_hub = pairs.groupBy("b").agg(F.sum("n").alias("values"))
    to_hubs = _links(spark, pairs.join(of_hub, "b").select("a", "b", "tier", F.xxhash64(
        _part(F.col("b"), all_values), _part(F.col("a"), F.col("values"))).alias("tile")), whole)
    B.forget(spark, pairs)
    up = to_hubs.groupBy("a").agg(F.max("b").alias("b"))
    up = B.scratch_table(spark, up, "up")
    roots = up.alias("p").join(up.alias("q"), F.col("p.b") == F.col("q.a"), "left").select(
        F.col("p.a").alias("cls"), F.coalesce("q.b", "p.b").alias("root"))

    # classes of lists that are not yet one: each pair in its first common list, and only if it may be news
    labelled = members.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    posts = labelled.select("cls", "tier", "n", "root", F.explode("lists").alias("value"))
    split = posts.groupBy("tier", "value").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum("n").alias("values"))
    split = split.where("lo < hi").select("tier", "value", "values")
    open_ = (posts.join(split, ["tier", "value"]).repartition("cls", "tier").groupBy("cls", "tier", "n", "root")
             .agg(F.sort_array(F.collect_list("value")).alias("open"), F.max(F.struct("values", "value")).alias("home")))
    # classes of one large list are of one block, or of the parts of it, so that what a class meets is in few tiles
    block = F.xxhash64(_part(F.col("home.value"), all_values), _part(F.col("cls"), F.col("home.values")))
    open_ = B.scratch_table(spark, open_.select("cls", "tier", "n", "root", block.alias("block"), "open"), "open")
    others = _met(spark, open_, whole)
    B.forget(spark, members, open_, up, whole)
    root = components(spark, to_hubs.union(others))

    grouped = first.join(root.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = grouped.join(least, "root").select("cls", "component_id", "root")
    out = rows.select("id", "print", "n_shingles", "cls").join(of_class, "cls", "left")
    found = F.when(F.col("cls").isNull(), F.col("id")).otherwise(
        F.nullif(F.col("component_id"), F.lit((1 << 63) - 1)))
    return out.select(F.col("id").alias(id_col), "n_shingles", found.alias("component_id"),
                      F.col("id").eqNullSafe(found).alias("kept"), "cls", "root", "print")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: near-duplicate components at a Jaccard similarity of 0.75."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(spark, docs).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS s
      FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r AS (SELECT doc_id AS a, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(root) AS component_id, w.doc_id = min(root) AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.a = w.doc_id GROUP BY w.doc_id, n.n
"""
