"""Question inputs and result sinks (S5, S6, S7 via answer.numbered_results, S8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.functions.text import py_strip
from issuelens.schemas import QUESTION_JSON


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their position (file order) as ``line_no``."""
    return (spark.read.text(path)
            .withColumn("line_no", F.monotonically_increasing_id())
            .withColumnRenamed("value", "line"))


def read_question_lines(spark: SparkSession, path: str) -> DataFrame:
    """One question per line; blanks dropped; ``#`` comments only when the
    **unstripped** line starts with ``#`` (so ``"  # x"`` is a question)."""
    df = _lines(spark, path)
    q = py_strip("line")
    return (df.where((F.length(q) > 0) & ~F.col("line").startswith("#"))
            .select(F.col("line_no").alias("question_id"), q.alias("question")))


def read_question_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines; stripped blanks and ``#`` lines skipped; malformed lines
    are returned separately (the reference warns and skips them).

    Returns ``(questions, malformed)``.
    """
    df = _lines(spark, path)
    s = py_strip("line")
    kept = df.where((F.length(s) > 0) & ~s.startswith("#")).withColumn("_s", s)
    schema = T.StructType(list(QUESTION_JSON.fields) + [T.StructField("_corrupt", T.StringType())])
    parsed = kept.withColumn("j", F.from_json("_s", schema, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"}))
    bad = F.col("j").isNull() | F.col("j._corrupt").isNotNull() | ~F.col("_s").startswith("{")
    good = parsed.where(~bad).select(
        F.col("line_no").alias("question_id"), F.col("j.question").alias("question"),
        F.coalesce(F.col("j.expected_ids"), F.array().cast("array<string>")).alias("expected_ids"),
        F.coalesce(F.col("j.tags"), F.array().cast("array<string>")).alias("tags"))
    malformed = parsed.where(bad).select("line_no", "line")
    return good, malformed


def write_eval_results(results: DataFrame, path: str) -> None:
    """One JSON object per question."""
    results.write.mode("errorifexists").json(path)


def write_numbered(numbered: DataFrame, path: str) -> None:
    """Header line then the answer, in question order.

    The sort is range-partitioned, so the part files read in name order
    give the questions in order without funnelling them through one task.
    """
    body = F.concat(F.col("header"), F.lit("\n"), F.coalesce(F.col("answer"), F.lit("")), F.lit("\n"))
    numbered.orderBy("position").select(body.alias("value")).write.mode("errorifexists").text(path)
