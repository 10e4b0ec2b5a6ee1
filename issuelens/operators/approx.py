"""Approximate search (V5) by random-projection buckets, with exact ranking of what they bring together.

Spark ML's ``BucketedRandomProjectionLSH`` projects every vector on random
directions; a few of them together are a bucket, and a question meets the
chunks that share one of its buckets in one of the tables.  Buckets take the
place of filters in the exact search: the same blocks, kernel, cuts and
ranking, so scores are exact and a crowded bucket is spread over many tasks.
What is lost are neighbours that share no bucket: ``recall`` measures it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.operators.search import SearchSpec, _beside, question_blocks, rank_candidates


@dataclass(frozen=True)
class Buckets:
    """``tables`` of buckets of ``projections`` directions each, ``width`` wide (in units of distance)."""

    tables: int = 12
    projections: int = 4
    width: float = 0.3
    seed: int = 17


def fit(spark: SparkSession, dim: int, buckets: Buckets) -> BucketedRandomProjectionLSHModel:
    """The directions: they follow from the seed and the dimension, not from data."""
    one = spark.range(1).select(array_to_vector(F.array_repeat(F.lit(0.0), dim)).alias("_v"))
    return BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=buckets.width, seed=buckets.seed,
                                       numHashTables=buckets.tables * buckets.projections).fit(one)


def keyed(df: DataFrame, vector: str, model: BucketedRandomProjectionLSHModel, buckets: Buckets) -> DataFrame:
    """A row for each table, with its bucket as ``bucket``."""
    cell = [vector_to_array(F.col("_h")[i])[0].cast("long").cast("string") for i in range(buckets.tables * buckets.projections)]
    keys = F.array(*(F.concat_ws(":", F.lit(str(t)), *cell[t * buckets.projections:(t + 1) * buckets.projections])
                     for t in range(buckets.tables)))
    hashed = model.transform(df.where(F.col(vector).isNotNull()).withColumn(
        "_v", array_to_vector(F.col(vector).cast("array<double>"))))
    return hashed.withColumn("bucket", F.explode(keys)).drop("_v", "_h")


def search_approx(spark: SparkSession, collection: DataFrame, questions: DataFrame, spec: SearchSpec,
                  buckets: Buckets = Buckets()) -> DataFrame:
    """``question_id, id, parent, score, raw_score, rank`` as ``search`` gives them, among the chunks of equal buckets."""
    first = questions.select(F.size("vector").alias("d")).where("d > 0").limit(1).collect()
    model = fit(spark, first[0].d if first else 1, buckets)
    chunk = F.col("chunk_id") if "chunk_id" in collection.columns else F.col("id")
    # a chunk comes once from each table it shares a bucket in: the best row stays, as of windows
    coll = keyed(collection.select("id", "parent", chunk.alias("chunk_id"), "embedding"), "embedding", model, buckets)
    asked = keyed(questions.select("question_id", "vector"), "vector", model, buckets)
    blocks = question_blocks(spark, asked, ("bucket",))
    return rank_candidates(_beside(coll, blocks, spec, ("bucket",)), coll, spec)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: hits that the exact search has, how many of them were found, and their share."""
    both = exact.select("question_id", "id").join(found.select("question_id", "id", F.lit(1).alias("_f")),
                                                  ["question_id", "id"], "left")
    return both.agg(F.count(F.lit(1)).alias("wanted"), F.count("_f").alias("found")).withColumn(
        "recall", F.col("found") / F.nullif(F.col("wanted"), F.lit(0)))
