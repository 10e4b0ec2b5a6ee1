"""Mixing sources to target weights by a low-discrepancy schedule.

Sources share all words by weight, none above three times its own size.  The
words of a source's documents, in shuffled order (by the md5 of doc_id), are
cut into blocks of equal length, about a thousandth of its target, and as
many slots are planned for it as meet its target in whole blocks.

The schedule has a power of two of slots.  Slot i falls on the source whose
stretch of the summed slot numbers holds the van der Corput point of i (its
bits reversed), so every stretch of the schedule is close to the targets and
the whole of it gives each source exactly its slots.  Slots are ranked within
their source; rank r takes block r modulo the source's number of blocks, so no
document is taken more than three times over.  A document's taken words are
read off the running sums of its source's scheduled blocks at its first word
and behind its last.

All steps are joins, aggregates and windows over bounded groups: running
sums and ranks are taken within buckets and shifted by the buckets' totals.
A source misses its target by less than a block, at any size of the corpus.

Cases: null texts have size 0 and are taken 0 times; null sources are one
source, the last; a null doc_id is shuffled as the word null; rows of equal
doc_id are laid out by size; empty tables give no rows.  Input columns named
like a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from issuelens.llm import blocks as B

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No source, and so no document, is taken more often.
MAX_REPEATS = 3
#: Slots of a source, about: its blocks are its target over this, of one word at least.
SLOTS = 1024
#: Targets are doubles: a whole number of words that came out a little less is meant whole.
_ROUNDING = 1e-6
_CELLS = 4096
_CHUNK = 1 << 16
RESULT = ("size", "source_size", "target", "taken")


def n_words(text: str) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a column; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str, weights: tuple[float, ...] = WEIGHTS,
            repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source ``(source, _src, source_size, target, lo, hi)``: its number, target words and share of [0, 1).

    Raising a common level L until min(repeats * size, L * weight) sums to all
    words is the same as resharing the excess until none is left: in order of
    the level at which a source is full, the full ones come first.
    """
    src = sizes.groupBy(F.col(source).alias("source")).agg(F.sum("_size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    src = src.withColumn("_src", F.row_number().over(order).cast("long"))
    src = src.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)),
                                                 ((F.col("_src") - 1) % len(weights) + 1).cast("int")))
    src = src.withColumn("_cap", F.col("source_size").cast("double") * repeats)
    by_level = Window.orderBy(F.col("_cap") / F.col("_weight"), "_src")
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = src.withColumn("_level", (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(below), F.lit(0.0)))
                         / F.sum("_weight").over(onward))
    src = src.withColumn("_full", F.col("_level") >= F.col("_cap") / F.col("_weight"))
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(every)
    src = src.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(level * F.col("_weight")))
    return src.select("source", "_src", "source_size", "target")


def blocked(src: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``src`` with ``block`` (words of a block), ``blocks`` (their number), ``slots`` and where its points lie, lo to hi."""
    goal = F.floor(F.col("target") + _ROUNDING)
    src = src.withColumn("_goal", goal).withColumn("block", F.greatest(F.lit(1), F.ceil(F.col("_goal") / slots)).cast("long"))
    src = src.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    some = F.col("source_size") > 0
    whole = F.when(some, F.floor(F.col("_goal") / F.nullif("source_size", F.lit(0))) * F.col("blocks")
                   + F.floor(F.col("_goal") % F.nullif("source_size", F.lit(0)) / F.col("block"))).otherwise(F.lit(0))
    src = src.withColumn("slots", whole.cast("long")).drop("_goal")
    hi = F.sum("slots").over(Window.orderBy("_src").rowsBetween(Window.unboundedPreceding, 0))
    return src.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("slots"))


def schedule(spark: SparkSession, src: DataFrame) -> DataFrame:
    """Slots ``(slot, _src, rank, block_no, round)`` of the sources of ``blocked``, in the order the mix reads."""
    total = src.agg(F.sum("slots")).first()[0] or 0
    bits = max(total - 1, 0).bit_length()
    width = max((1 << bits) // _CELLS, 1)
    point = F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")
    slots = spark.range(1 << bits if total else 0).select(F.col("id").alias("slot"), point.alias("x"))
    slots = slots.where(F.col("x") < total).withColumn("cell", F.floor(F.col("x") / width))
    shares = src.where("slots > 0").select("_src", "lo", "hi", "blocks", F.explode(
        F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    slots = slots.join(shares, "cell").where("x >= lo and x < hi")
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / _CHUNK))
    per = slots.groupBy("_src", "chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_src", "chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_src", "chunk").orderBy("slot")) - 1
    slots = slots.withColumn("rank", rank).join(per, ["_src", "chunk"])
    slots = slots.withColumn("rank", F.col("rank") + F.col("_before"))
    return slots.select("slot", "_src", "rank", (F.col("rank") % F.col("blocks")).alias("block_no"),
                        F.floor(F.col("rank") / F.col("blocks")).alias("round"))


def scheduled_blocks(src: DataFrame, slots: DataFrame) -> DataFrame:
    """``(_src, block_no, times, before)``: how often each block is read, and the words read of the blocks before it.

    The row behind a source's last block closes the sums.
    """
    every = src.select("_src", "block", "blocks", "source_size",
                       F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks"))).alias("block_no"))
    read = slots.groupBy("_src", "block_no").agg(F.count("*").alias("times"))
    every = every.join(read, ["_src", "block_no"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    words = F.least(F.col("block"), F.col("source_size") - F.col("block_no") * F.col("block")) * F.col("times")
    before = Window.partitionBy("_src").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    return every.select("_src", "block_no", "times", F.coalesce(F.sum(words).over(before), F.lit(0)).alias("before"))


def layout(docs: DataFrame, n_docs: int) -> DataFrame:
    """Adds ``_at``: the words before a document in its source's shuffled order."""
    digits = 1
    while n_docs > 20_000 * 16 ** digits:
        digits += 1
    docs = (docs.withColumn("_key", F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("null")).cast("binary")))
            .withColumn("_bucket", F.substring("_key", 1, digits)))
    per = docs.groupBy("_src", "_bucket").agg(F.sum("_size").alias("_n"))
    before = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_src", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_src", "_bucket").orderBy("_key", "_size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    return docs.join(per, ["_src", "_bucket"]).withColumn("_at", F.col("_before") + F.col("_in"))


def mix(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text",
        source: str = "source", repeats: int = MAX_REPEATS, slots: int = SLOTS) -> DataFrame:
    """``(doc_id, size, source, source_size, target, taken)`` of every document."""
    sizes = docs.select(F.col(id_col).alias("_id"), F.col(source).alias("_source"), n_words(text).alias("_size"))
    sizes = B.scratch_table(spark, sizes, "mix-sizes")
    n_docs = sizes.count()
    src = B.scratch_table(spark, blocked(targets(sizes, "_source", repeats=repeats), slots), "mix-sources")
    read = B.scratch_table(spark, scheduled_blocks(src, schedule(spark, src)), "mix-blocks")
    placed = sizes.join(src, F.col("_source").eqNullSafe(F.col("source"))).select("_id", "_size", "_src")
    out = layout(placed, n_docs).select("_src", "_id", "_size", "_at")
    out = out.join(src.select("_src", "source", "source_size", "target", "block"), "_src")

    def words_read(df: DataFrame, at: Column, name: str) -> DataFrame:
        """``name``: words that the schedule reads of the source's first ``at``."""
        df = df.withColumn("_x", at).withColumn("block_no", F.floor(F.col("_x") / F.col("block")))
        df = df.join(read, ["_src", "block_no"])
        return df.withColumn(name, F.col("before") + F.col("times") * (F.col("_x") - F.col("block_no") * F.col("block"))).drop(
            "_x", "block_no", "times", "before")

    out = words_read(out, F.col("_at"), "_from")
    out = words_read(out, F.col("_at") + F.col("_size"), "_to")
    return out.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("source").alias(source),
        "source_size", "target", (F.col("_to") - F.col("_from")).cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed 5 : 2 : 1 by source."""
    return mix(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "source_size", "target", "taken")


def oracle(table: str = "documents") -> str:
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
           FROM {table}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k
      FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
             3 * CAST(source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, k
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, CASE WHEN level >= cap / weight THEN cap
                ELSE weight * max(level) FILTER (level < cap / weight) OVER () END AS target FROM l),
g AS (SELECT *, CAST(floor(target + 1e-6) AS BIGINT) AS goal FROM t),
bs AS (SELECT *, greatest(1, (goal + {SLOTS - 1}) // {SLOTS}) AS block FROM g),
n AS (SELECT *, (source_size + block - 1) // block AS blocks,
             CASE WHEN source_size > 0 THEN goal // source_size * ((source_size + block - 1) // block) + goal % source_size // block
                  ELSE 0 END AS slots FROM bs),
a AS (SELECT d.doc_id, d.size, n.*,
             coalesce(sum(size) OVER (PARTITION BY n.k ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), size
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE size * (slots // blocks)
            + greatest(0, least(pos + size, (slots % blocks) * block) - pos) END AS BIGINT) AS taken
FROM a
"""


ORACLE = oracle()
