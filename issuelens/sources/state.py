"""Load checkpoints and sync state as small tables (S9, S10, M10-M11 storage).

State lives in JSON files, one object per project.  Absent or corrupt
files never fail a run: they read as the defaults (offset 0, nothing done,
never synced), and partial objects get the missing keys filled in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.operators.tables import expire, next_version, versions
from issuelens.schemas import LOAD_CHECKPOINT, SYNC_STATE

ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _read_objects(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """Per-project JSON objects; corrupt text reads as an all-NULL row and is dropped."""
    existing = []
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        if hp.getFileSystem(conf).exists(hp):
            existing.append(p)
    full = T.StructType([f for f in schema.fields if f.name != "project_id"]
                        + [T.StructField("_corrupt", T.StringType())])
    if not existing:
        return spark.createDataFrame([], full).withColumn("_file", F.lit(None).cast("string"))
    df = (spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt").json(existing))
    return df.withColumn("_file", F.input_file_name()).where(F.col("_corrupt").isNull())


def load_sync_state(spark: SparkSession, state_dir: str, project_ids: Sequence[str]) -> DataFrame:
    """S9 + S10: ``project_id, last_synced_at, sync_count`` for every listed project.

    The newest saved state counts; a project that it lacks is looked up in
    its own file ``<project>_sync.json``.
    """
    root = state_dir.rstrip("/")
    saved = versions(spark, root)
    fields = "project_id string, last_synced_at string, sync_count int"
    table = (spark.read.schema(fields).json(f"{root}/v={saved[-1]}") if saved
             else spark.createDataFrame([], fields)).where(F.col("project_id").isNotNull())
    files = _read_objects(spark, [f"{root}/{p}_sync.json" for p in project_ids], SYNC_STATE)
    files = files.withColumn("project_id", F.regexp_extract("_file", r"([^/]+)_sync\.json$", 1))
    files = files.select("project_id", "last_synced_at", "sync_count").join(table, "project_id", "left_anti")
    wanted = spark.createDataFrame([(p,) for p in project_ids], "project_id string")
    return (wanted.join(table.unionByName(files), "project_id", "left")
            .select("project_id", F.col("last_synced_at"),
                    F.coalesce(F.col("sync_count"), F.lit(0)).cast("int").alias("sync_count")))


def save_sync_state(state: DataFrame, state_dir: str) -> None:
    """One JSON object per project, as a new version under ``state_dir``."""
    root = state_dir.rstrip("/")
    (state.withColumn("_saved_at", F.date_format(F.current_timestamp(), ISO_UTC))
     .write.mode("errorifexists").json(f"{root}/v={next_version(state.sparkSession, root)}"))
    expire(state.sparkSession, root)


def load_checkpoints(spark: SparkSession, state_dir: str, project_ids: Sequence[str]) -> DataFrame:
    """S9 + S10 for download checkpoints; missing keys get their defaults."""
    paths = [f"{state_dir.rstrip('/')}/{p}_checkpoint.json" for p in project_ids]
    got = _read_objects(spark, paths, LOAD_CHECKPOINT)
    got = got.withColumn("project_id", F.regexp_extract("_file", r"([^/]+)_checkpoint\.json$", 1))
    wanted = spark.createDataFrame([(p,) for p in project_ids], "project_id string")
    return (wanted.join(got, "project_id", "left")
            .select("project_id",
                    F.coalesce("offset", F.lit(0)).cast("bigint").alias("offset"),
                    F.col("total"),
                    F.coalesce("successful_ids", F.array().cast("array<bigint>")).alias("successful_ids"),
                    F.coalesce("failed_ids", F.create_map().cast("map<string,int>")).alias("failed_ids")))


def is_complete(checkpoints: DataFrame) -> DataFrame:
    """A project is complete when its done count reaches the total (``>=``)."""
    return checkpoints.select("project_id", (F.size("successful_ids") >= F.col("total")).alias("complete"))
