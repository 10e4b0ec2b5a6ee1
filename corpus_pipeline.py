"""Cleaning a corpus in stages, each over all documents that the stage before kept.

Toxic documents go; of each group of near-duplicates the smallest doc_id
stays; passages that an earlier document has are cut; benchmark passages are
cut, and documents that are mostly benchmark go; what is left is mixed.

Cases: decisions are taken by row, so rows that share a doc_id, or have none,
stand or fall by their own text; of a group the row of smallest doc_id stays
(null last, then by a hash of the text), and of rows equal in doc_id and text
one.  Documents without words are copies of nothing and stay.  All columns of
the input come back as they were, also those named like a column of an
operator; only ``text`` is cut and ``n_chars``, where there is one, follows it.
Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.llm import blocks, decontaminate, minhash, mixing, substring_dedup, toxicity
from issuelens.session import ship_package

#: SQL cannot state the toxicity model; tests/llm checks the stages one by one.
ORACLE_SQL = None


def _as_before(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars, where there is one, of the text as it is now."""
    out = changed.select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def _apart(docs: DataFrame, names: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs``, whose own columns called like its results stand aside meanwhile."""
    aside = {c: f"_given_{c}" for c in docs.columns if c in names}
    return work(docs.withColumnsRenamed(aside)).select(
        *(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(work: Stage) -> Stage:
    """A stage; what the stage before left in the shared folder goes, as its result is a written table by now."""
    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        with blocks.owned_scratch(spark, "pipeline"):
            return work(spark, docs, sf_dir)
    return run_stage


@_stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from the labels of these documents."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _apart(docs, ("score",), lambda d: toxicity.score_documents(spark, d, model).where("score < 0.5"))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component."""
    found = minhash.near_duplicates(spark, docs).where("root is not null").select(
        F.col("doc_id").alias("_id"), F.col("print").alias("_print"), "root")
    found = blocks.scratch_table(spark, found, "near-duplicates")
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_print").alias("print"))
    best = found.groupBy("root").agg(F.min(place).alias("best"))
    gone = found.join(best, "root").where(place != F.col("best")).select("_id", "_print").distinct()
    twice = found.groupBy("_id", "_print").agg(F.count("*").alias("n")).where("n > 1").select("_id", "_print")

    def rows(ids: DataFrame, how: str, of: DataFrame) -> DataFrame:
        few = ids.count() <= blocks.BROADCAST_IDS
        same = of["doc_id"].cast("long").eqNullSafe(ids["_id"]) & (F.xxhash64(of["text"]) == ids["_print"])
        return of.join(F.broadcast(ids) if few else ids, same, how)

    left = rows(blocks.scratch_table(spark, gone, "gone"), "left_anti", docs)
    if not twice.limit(1).count():
        return left
    twice = blocks.scratch_table(spark, twice, "repeated-rows")
    return rows(twice, "left_anti", left).unionByName(rows(twice, "left_semi", left).dropDuplicates(["doc_id", "text"]))


@_stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; documents stay."""
    # smaller blocks than the operator alone takes: executors still keep the memory of the stages before
    def cut(d: DataFrame) -> DataFrame:
        return substring_dedup.substring_dedup(spark, d, block_bytes=blocks.BLOCK_BYTES // 4,
                                               bucket_keys=blocks.BUCKET_KEYS // 2)

    return _as_before(_apart(docs, substring_dedup.RESULT, cut), docs)


@_stage
def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go, with documents of which they are more than half."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _as_before(_apart(docs, decontaminate.RESULT, lambda d: decontaminate.clean(spark, d, items)), docs)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(spark, docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each from the written table of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = blocks.scratch_table(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
