"""Prompt assembly, answer generation and source presentation.

Hits are bounded by ``questions x top_k``, so gathering the blocks of one
question is a bounded ``collect_list``; the question side drives a left
join so questions without hits still get a prompt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens import config as C
from issuelens.functions.text import non_empty, or_empty, py_strip
from issuelens.operators.ordering import with_index

HIT_META = ("issue_id", "project", "status", "priority", "created_on", "updated_on", "subject",
            "project_id")


def _meta(c: str) -> Column:
    # after D1 metadata are never NULL, so NULL means the key is absent
    return F.coalesce(F.col(c).cast("string"), F.lit(C.MISSING_META))


def issue_block() -> Column:
    """One block per hit, in the fixed template."""
    return F.concat(
        F.lit("[Issue #"), _meta("issue_id"), F.lit(" | "), _meta("project"), F.lit(" | "),
        _meta("status"), F.lit(" | "), _meta("priority"), F.lit(" | created: "),
        _meta("created_on"), F.lit(" | updated: "), _meta("updated_on"), F.lit("]\n"),
        py_strip(or_empty("text")), F.lit("\n"),
    )


def hit_details(hits: DataFrame, collection: DataFrame) -> DataFrame:
    """Attach the whole stored text and the metadata of each hit's chunk.

    Every hit comes from the collection, so this is an inner join; its
    strategy is left to the sizes that Spark sees.
    """
    if "part" in collection.columns:  # a chunk's text stands in the row of its first window
        collection = collection.where("part = 0").withColumn("id", F.col("chunk_id"))
    want = ["id", "text"] + [c for c in HIT_META if c in collection.columns]
    coll = collection.select(*want).withColumnRenamed("issue_id", "meta_issue_id")
    out = coll.join(hits, "id", "inner")
    if "meta_issue_id" in out.columns:
        out = out.withColumnRenamed("meta_issue_id", "issue_id")
    return out


def build_prompts(questions: DataFrame, detailed_hits: DataFrame) -> DataFrame:
    """``question_id, prompt``; questions without hits get the placeholder."""
    blocks = (detailed_hits
              .select("question_id", F.struct(F.col("rank"), issue_block().alias("b")).alias("rb"))
              .groupBy("question_id")
              .agg(F.array_sort(F.collect_list("rb")).alias("rbs")))
    joined = F.array_join(F.transform("rbs", lambda x: x.getField("b")), C.BLOCK_SEPARATOR)
    body = F.when(F.col("rbs").isNotNull() & (F.size("rbs") > 0), joined).otherwise(F.lit(C.NO_ISSUES_TEXT))
    q = questions.select("question_id", "question")
    return (q.join(blocks, "question_id", "left")
            .select("question_id",
                    F.concat(F.lit(C.PROMPT_HEAD), body, F.lit(C.PROMPT_TAIL),
                             or_empty("question"), F.lit("\n")).alias("prompt")))


def generate(prompts: DataFrame, model_factory: Callable[[], Callable[[str, str], str]],
             prompt_col: str = "prompt") -> DataFrame:
    """Answer every prompt with an injected chat model (system + user message).

    The model is built once per Python worker; prompts arrive in Arrow
    batches.  ``model(system, prompt) -> answer``.
    """
    schema = T.StructType(list(prompts.schema.fields) + [T.StructField("answer", T.StringType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for pdf in it:
            pdf = pdf.copy()
            pdf["answer"] = [model(C.SYSTEM_PROMPT, p) for p in pdf[prompt_col].fillna("")]
            yield pdf

    return prompts.mapInPandas(run, schema)


def citation_model() -> Callable[[str, str], str]:
    """Offline stand-in for the chat model: cites every retrieved issue in order."""
    import re

    pat = re.compile(r"^\[Issue #([^ |]*) \|", re.M)

    def answer(system: str, prompt: str) -> str:
        ids = pat.findall(prompt)
        if not ids:
            return "The retrieved issues do not contain enough information to answer."
        return "Relevant issues: " + ", ".join(f"(Issue #{i})" for i in ids)

    return answer


def source_cards(detailed_hits: DataFrame, base_url: str = C.TRACKER_BASE_URL) -> DataFrame:
    """R11 + R13: fields of the source cards shown next to an answer."""
    base = base_url.rstrip("/")
    iid = F.coalesce(F.col("issue_id").cast("string"), F.lit(""))
    prio = or_empty("priority")
    return detailed_hits.select(
        "question_id", "rank", iid.alias("issue_id"),
        F.concat(F.lit(base + "/issues/"), iid).alias("issue_url"),
        F.substring(or_empty("subject"), 1, 120).alias("subject"),
        or_empty("project").alias("project"),
        or_empty("project_id").alias("project_id"),
        or_empty("status").alias("status"),
        prio.alias("priority"),
        F.substring(or_empty("created_on"), 1, 10).alias("created_on"),
        F.substring(or_empty("updated_on"), 1, 10).alias("updated_on"),
        F.format_string("%.4f", F.col("raw_score") if "raw_score" in detailed_hits.columns
                        else F.col("score")).alias("score_text"),
        F.substring(py_strip(or_empty("text")), 1, 600).alias("snippet"),
        F.when(non_empty(prio) & (prio != "Normal"), prio).alias("priority_badge"),
    )


def source_list(detailed_hits: DataFrame) -> DataFrame:
    """Id, project, status, score and short subject per hit."""
    return detailed_hits.select(
        "question_id", "rank", _meta("issue_id").alias("issue_id"), _meta("project").alias("project"),
        _meta("status").alias("status"),
        F.format_string("%.4f", F.col("score")).alias("score_text"),
        F.substring(or_empty("subject"), 1, 80).alias("subject"),
    )


def numbered_results(answers: DataFrame, order_col: str = "question_id") -> DataFrame:
    """``=== Qi/n: question ===`` headers in input order (distributed numbering)."""
    numbered = with_index(answers, [order_col], "_i", "_n")
    return (numbered
            .withColumn("header", F.concat(F.lit("=== Q"), F.col("_i").cast("string"), F.lit("/"),
                                           F.col("_n").cast("string"), F.lit(": "), or_empty("question"),
                                           F.lit(" ===")))
            .withColumnRenamed("_i", "position").drop("_n"))
