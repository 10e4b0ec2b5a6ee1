"""Issue files: per-project JSON arrays in, versioned parquet out.

Every write goes to a new ``v=<n>`` directory (see ``operators.tables``),
so a job can read the current master and write the next one in the same run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.operators.tables import expire, file_system, next_version, versions
from issuelens.schemas import ISSUE, USER_MAPPING


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


#: What stands between the objects of an array that is written with two spaces of indent, and before the first.
#: Text inside an object cannot look like that: JSON strings hold no line breaks.
BETWEEN, BEFORE = "\n  },\n  {", "[\n  {\n"

_SEQ = "struct<project_rank:int,block:bigint,pos:bigint>"


def _indented(spark: SparkSession, path: str) -> bool:
    """Whether a file begins as an array of objects with two spaces of indent (reads its first bytes only)."""
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(max(stream.read(), 0) for _ in BEFORE) == BEFORE.encode()
    finally:
        stream.close()


def _split_arrays(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Objects of indented arrays, each file cut into byte ranges that are read side by side."""
    text = spark.read.option("lineSep", BETWEEN).text(paths).select(
        "value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))
    body = F.regexp_replace(F.regexp_replace("value", r"\A\[\n  \{", ""), r"\n  \}\n\]\s*\z", "")
    return (text.withColumn("_issue", F.from_json(F.concat(F.lit("{"), body, F.lit("}")), ISSUE))
            .select("_issue.*", "_path", "_block", F.monotonically_increasing_id().alias("_pos")))


def _whole_arrays(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Objects of arrays in any layout: a file is read by one task."""
    return (spark.read.schema(ISSUE).option("multiLine", True).option("mode", "PERMISSIVE").json(paths)
            .select("*", F.input_file_name().alias("_path"), F.lit(0).cast("long").alias("_block"),
                    F.monotonically_increasing_id().alias("_pos")))


def read_project_files(spark: SparkSession, raw_dir: str, project_ids: Sequence[str]) -> DataFrame:
    """S1 + S11 + S12: the JSON-array files ``<raw_dir>/<project>.json`` of the listed projects.

    Absent files are skipped (an absent project reads as empty).  Each row
    is tagged with the project of the file it came from, and ``seq`` keeps
    the file order (project position, byte range, position in it) so
    order-dependent rules (first-seen names, last-wins dedup) are exact.

    Files in the layout that downloads are saved in, two spaces of indent, are
    split by bytes whatever their size; others are read by one task each.
    """
    paths = [(i, p, f"{raw_dir.rstrip('/')}/{p}.json") for i, p in enumerate(project_ids)]
    present = [(i, p, path) for i, p, path in paths if _exists(spark, path)]
    if not present:
        return spark.createDataFrame([], ISSUE).withColumn("seq", F.lit(None).cast(_SEQ))
    rank = F.create_map(*[F.lit(x) for i, p, _ in present for x in (p, i)])
    split = [path for _, _, path in present if _indented(spark, path)]
    whole = [path for _, _, path in present if path not in split]
    parts = ([_split_arrays(spark, split)] if split else []) + ([_whole_arrays(spark, whole)] if whole else [])
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    project = F.regexp_extract("_path", r"([^/]+)\.json$", 1)
    return (df.withColumn("_file_project", project)
            .withColumn("project_identifier", F.coalesce("project_identifier", "_file_project"))
            .withColumn("seq", F.struct(rank[F.col("_file_project")].alias("project_rank"), F.col("_block").alias("block"),
                                        F.col("_pos").alias("pos")))
            .drop("_file_project", "_path", "_block", "_pos"))


def full_scan(issues: DataFrame, project_id: str) -> DataFrame:
    """Every issue of one project, all statuses, ordered by id."""
    return issues.where(F.col("project_identifier") == project_id).orderBy("id")


def write_issues(issues: DataFrame, root: str, partition_col: str = "project_identifier") -> int:
    """S3: write an issue set as the next version, partitioned by project."""
    spark = issues.sparkSession
    nxt = next_version(spark, root)
    issues.write.mode("errorifexists").partitionBy(partition_col).parquet(f"{root}/v={nxt}")
    expire(spark, root)
    return nxt


def read_issues(spark: SparkSession, root: str, project_ids: Sequence[str] | None = None) -> DataFrame:
    """The current version; a project list prunes partitions at the scan."""
    vs = versions(spark, root)
    if not vs:
        return spark.createDataFrame([], ISSUE)
    df = spark.read.parquet(f"{root}/v={vs[-1]}")
    if project_ids:
        df = df.where(F.col("project_identifier").isin(*project_ids))
    return df


def write_user_mapping(mapping: DataFrame, path: str) -> None:
    """The mapping goes to its own (restricted) location, never next to the data."""
    mapping.select(*[f.name for f in USER_MAPPING.fields]).write.mode("errorifexists").parquet(path)
