"""Retrieval evaluation (Q1-Q7).

Relevance is decided per hit (a join or a predicate against the hit row),
so the expected-id set of a question never has to be gathered into one
array; when explicit expected ids exist they are exploded and joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issuelens import config as C


def expected_from_lists(questions: DataFrame) -> DataFrame:
    """Q1: ``question_id, expected_id`` rows from an ``expected_ids`` array (as strings)."""
    return (questions.select("question_id",
                             F.explode(F.array_distinct(F.transform(
                                 F.coalesce("expected_ids", F.array().cast("array<string>")),
                                 lambda x: x.cast("string")))).alias("expected_id")))


def per_question(questions: DataFrame, hits: DataFrame, expected: DataFrame | None = None,
                 relevant_col: str | None = None) -> DataFrame:
    """Q2 + Q3 per question.

    ``hits``: ``question_id, issue_id, score`` (already cut to top-k).
    Relevance comes either from ``expected`` (``question_id, expected_id``)
    or from a boolean column ``relevant_col`` on the hits.  ``hit`` is NULL
    when the question has nothing to be judged against (no expected ids).
    """
    h = hits.select("question_id", F.coalesce(F.col("issue_id"), F.lit("")).alias("issue_id"),
                    "score", *([relevant_col] if relevant_col else []))
    if expected is not None:
        e = expected.select("question_id", F.col("expected_id").alias("issue_id"),
                            F.lit(True).alias("_rel")).distinct()
        h = h.join(e, ["question_id", "issue_id"], "left") \
             .withColumn("_rel", F.coalesce("_rel", F.lit(False)))
        n_exp = expected.groupBy("question_id").agg(F.countDistinct("expected_id").alias("n_expected"))
    else:
        h = h.withColumn("_rel", F.coalesce(F.col(relevant_col), F.lit(False)))
        n_exp = None
    agg = h.groupBy("question_id").agg(
        F.sort_array(F.collect_set("issue_id")).alias("retrieved_ids"),
        F.min("score").alias("best_score"),
        F.count(F.lit(1)).alias("n_results"),
        F.max(F.col("_rel").cast("int")).alias("_any"),
    )
    out = questions.join(agg, "question_id", "left")
    if n_exp is not None:
        out = out.join(n_exp, "question_id", "left") \
                 .withColumn("n_expected", F.coalesce("n_expected", F.lit(0)))
    else:
        out = out.withColumn("n_expected", F.lit(1))
    return out.select(
        *questions.columns,
        F.coalesce("retrieved_ids", F.array().cast("array<string>")).alias("retrieved_ids"),
        "best_score",
        F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"),
        F.when(F.col("n_expected") == 0, F.lit(None).cast("boolean"))
         .otherwise(F.coalesce(F.col("_any"), F.lit(0)) == 1).alias("hit"),
    )


def label(hit_col: str = "hit"):
    """Q4: ``HIT`` / ``MISS`` / ``N/A``."""
    h = F.col(hit_col)
    return F.when(h.isNull(), F.lit("N/A")).when(h, F.lit("HIT")).otherwise(F.lit("MISS"))


def summary(results: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Q5: totals, hit rate @K (percent; NULL when nothing is evaluable), and of records the total time."""
    g = results.groupBy(*group_cols)
    time = [F.sum("elapsed").alias("total_elapsed")] if "elapsed" in results.columns else []
    return (g.agg(F.count(F.lit(1)).alias("total"),
                  F.count_if(F.col("hit").isNotNull()).alias("evaluable"),
                  F.count_if(F.col("hit")).alias("hits"),
                  F.count_if(F.col("hit").isNull()).alias("not_applicable"), *time)
            .withColumn("hit_rate_pct",
                        F.round(F.col("hits") * 100.0 / F.nullif(F.col("evaluable"), F.lit(0)), 6)))


def hit_rate_text(pct_col: str = "hit_rate_pct"):
    """``{:.0f}`` of the percentage (round half to even, like Python)."""
    return F.when(F.col(pct_col).isNotNull(),
                  F.concat(F.bround(F.col(pct_col), 0).cast("bigint").cast("string"), F.lit("%")))


def by_tag(results: DataFrame) -> DataFrame:
    """Q6: summary per tag (a question counts once in each of its tags)."""
    t = results.select("*", F.explode(F.array_distinct(F.coalesce(
        "tags", F.array().cast("array<string>")))).alias("tag"))
    return summary(t, ["tag"])


def sweep(candidates: DataFrame, ks: Sequence[int], thresholds: Sequence[float | None]) -> DataFrame:
    """Q7: hits for every (K, threshold) pair from one ranked candidate set.

    ``candidates``: ``question_id, id, parent, score`` ranked once with the
    largest window (``OVERFETCH * max(K)``) and ``fetch_rank`` = rank before
    de-duplication.  For a given K the result equals a search with that K:
    the first ``OVERFETCH*K`` candidates, best chunk per parent, top K, gate.
    The parameter grid is a literal array exploded per row (no join).
    """
    grid = F.array(*[F.struct(F.lit(k).alias("k"),
                              F.lit(t).cast("double").alias("t")) for k in ks for t in thresholds])
    c = candidates.select("*", F.explode(grid).alias("p")).select(
        "*", F.col("p.k").alias("k"), F.col("p.t").alias("threshold")).drop("p")
    c = c.where(F.col("fetch_rank") <= F.col("k") * C.OVERFETCH)
    wpar = Window.partitionBy("k", "threshold", "question_id", "parent").orderBy("fetch_rank")
    c = c.withColumn("_p", F.row_number().over(wpar)).where(F.col("_p") == 1)
    wq = Window.partitionBy("k", "threshold", "question_id").orderBy("fetch_rank")
    c = c.withColumn("rank", F.row_number().over(wq)).where(F.col("rank") <= F.col("k"))
    # the gate compares the same key the search gate uses (score to 9 digits)
    key = "rkey" if "rkey" in candidates.columns else "score"
    best = F.min(key).over(Window.partitionBy("k", "threshold", "question_id"))
    c = c.withColumn("_best", best).where(F.col("threshold").isNull() | (F.col("_best") <= F.col("threshold")))
    return c.drop("_p", "_best")


def records(results: DataFrame, applied: DataFrame, timings: DataFrame) -> DataFrame:
    """The record of each question: ``results`` of ``per_question``, with the filters that were used and the time it took.

    ``applied``: ``question_id, filters`` (JSON; of questions searched without filters it counts as ``{}``);
    ``timings``: ``question_id, elapsed`` in seconds, added up per question.
    """
    took = timings.groupBy("question_id").agg(F.sum("elapsed").alias("elapsed"))
    return (results.join(applied, "question_id", "left").join(took, "question_id", "left")
            .withColumn("filters", F.coalesce("filters", F.lit("{}")))
            .withColumn("elapsed", F.coalesce("elapsed", F.lit(0.0))))


def cube(judged: DataFrame, tags: DataFrame) -> DataFrame:
    """Q6 + Q7 in one aggregation: answered questions and hits by (tag, k, threshold), by (k, threshold), by tag and in all.

    ``judged``: ``k, threshold, question_id, hit`` of ``sweep``; ``tags``:
    ``question_id, tag``, one row per tag.  ``level`` tells the sets apart, as a
    threshold may itself be null.  A question counts once for each of its tags
    and, in the sets without tag, once for each tag as well: tags that split
    the questions give totals.
    """
    rows = judged.join(tags, "question_id")
    dims = [F.col("tag"), F.col("k"), F.col("threshold")]
    sets = [dims, [F.col("k"), F.col("threshold")], [F.col("tag")], []]
    return (rows.groupingSets(sets, *dims)
            .agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("answered"), F.count_if(F.col("hit")).alias("hits"))
            .withColumn("hit_rate_pct", F.round(F.col("hits") * 100.0 / F.nullif(F.col("answered"), F.lit(0)), 6)))
