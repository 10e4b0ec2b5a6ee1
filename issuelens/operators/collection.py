"""The vector collection (V1-V4, M3 for chunks): a bucket table of embedded chunk windows.

Windows of an issue share its bucket, so an upsert rewrites the buckets of the
issues that came in.  The project is a directory, so searches that filter by
it read its part only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.operators.tables import BucketTable, without
from issuelens.schemas import CHUNK

COLLECTION_SCHEMA = T.StructType(
    list(CHUNK.fields)
    + [T.StructField("chunk_id", T.StringType()),
       T.StructField("part", T.IntegerType()),
       T.StructField("embedding", T.ArrayType(T.DoubleType())),
       T.StructField("embed_model", T.StringType())]
)


class Collection:
    """``buckets``: of one collection always the same number."""

    def __init__(self, spark: SparkSession, root: str, name: str, buckets: int = 8):
        self.spark = spark
        self.path = f"{root.rstrip('/')}/{name}"
        self.table = BucketTable(spark, self.path, COLLECTION_SCHEMA, "issue_id", buckets, ("project_id",))

    def get_or_create(self) -> "Collection":
        """V4: an empty collection where none exists."""
        self.table.create()
        return self

    def read(self) -> DataFrame:
        return self.table.read()

    def count(self) -> int:
        """V2."""
        return self.read().count()

    def reset(self) -> "Collection":
        """V3: empties the collection; no error if it is absent."""
        self.table.reset()
        return self

    def replace(self, df: DataFrame) -> "Collection":
        """``df`` (one row per id) as the whole collection."""
        self.table.replace(df)
        return self

    def upsert(self, incoming: DataFrame, prune_stale: bool = False, issues: DataFrame | None = None) -> list[int] | None:
        """V1: incoming rows replace rows with the same id; answers the rewritten buckets.

        Empty input is a no-op (None).  With ``prune_stale`` the chunks of
        touched issues that are not in the incoming batch are removed as well.
        Of equal ids in one batch the greatest row stays; callers that need
        "last one wins" reduce the batch with merge.dedup_last first.

        ``issues``: the ``issue_id`` of the incoming rows, if their ids are known
        to be distinct and ``prune_stale`` is meant; they are then computed
        on their way to their buckets and not stored before.
        """
        if issues is not None:
            return self.table.upsert(incoming, lambda here, new: without(here, issues, "issue_id").unionByName(
                new.select(*here.columns)), issues) or None
        key = "issue_id" if prune_stale else "id"

        def merge(here: DataFrame, new: DataFrame) -> DataFrame:
            one = new.groupBy("id").agg(F.max(F.struct(*new.columns)).alias("_r")).select("_r.*")
            return without(here, new, key).unionByName(one)

        return self.table.upsert(incoming, merge) or None
