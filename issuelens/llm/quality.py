"""Quality rules as a short-circuit cascade, ordered by what a rule rejects for its cost.

Each rule is an SQL expression that is true for a document to reject.  On a
sample of the documents the cascade times every rule and notes which rules
reject which documents.  The order is built greedily: next comes the rule that
rejects most of the documents still there for each second it takes, so a rule
that only repeats an earlier one falls back.  One CASE then tests the rules in
that order, and a document pays for no rule behind the first that rejects it.
The order decides the cost and which rule is named; whether a document is kept
does not depend on it.

``measure`` gives the counts that rules may use: words, their code points,
symbols, repeated lines and words in repeated 3-word windows.  Everything is
DataFrame functions inside one scan; a document is never split into rows, so
no shuffle is needed and no key can be hot.

Cases: a null text is the empty text and a null doc_id stays null; repeated
rows are judged each for itself; empty tables give no rows; columns named like
a result are replaced by it.  A rule that is null for a document does not
reject it.  Windows are told apart by 64-bit hashes of their words.  A text is
worked on in one row: the memory it takes is about a hundred bytes a word.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.llm import blocks as B

#: Documents, about, on which rules are timed and counted.
SAMPLE = 2_000
#: Times that each rule is timed; the shortest counts.
RUNS = 2
#: Seconds below which two rules cost the same.
LEAST_COST = 0.005
#: Words of a window of which repeats are counted.
WINDOW = 3

_SPACE = r"\x20\x09-\x0D"


@dataclass(frozen=True)
class Rule:
    """``rejects``: an SQL expression over the columns at hand, true for documents to reject."""

    name: str
    rejects: str


#: Documents without these are not worth measuring further.
BASE_RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
)

#: Lines with a word that match one of these count as bullets, or as cut off.
BULLET = r"^[\x20\x09-\x0D]*[-*•‣◦⁃]"
CUT_OFF = r"(\.\.\.|…)[\x20\x09-\x0D]*$"

#: The rules of the registered query.  ``text`` is never null here.
RULES = (
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", rf"n_dup_lines > 1 and 10 * n_dup_lines > 3 * size(filter(split(text, '\n', -1), x -> x rlike r'[^{_SPACE}]'))"),
    Rule("bullets", rf"10 * size(filter(split(text, '\n', -1), x -> x rlike r'{BULLET}'))"
                    rf" > 9 * size(filter(split(text, '\n', -1), x -> x rlike r'[^{_SPACE}]'))"),
    Rule("cut_off_lines", rf"10 * size(filter(split(text, '\n', -1), x -> x rlike r'{CUT_OFF}'))"
                          rf" > 3 * size(filter(split(text, '\n', -1), x -> x rlike r'[^{_SPACE}]'))"),
    Rule("words_without_letter", rf"10 * regexp_count(text, r'[^{_SPACE}]*\p{{L}}[^{_SPACE}]*') < 7 * n_words"),
)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of ``text``; null text: empty."""
    q = docs.withColumn("_q_text", F.coalesce(F.col(text), F.lit("")))
    q = q.withColumn("_q_words", F.regexp_extract_all("_q_text", F.lit(f"[^{_SPACE}]+"), F.lit(0)))
    q = q.withColumn("_q_lines", F.expr(rf"filter(split(_q_text, '\n', -1), x -> x rlike r'[^{_SPACE}]')"))
    q = q.withColumn("_q_hash", F.expr("transform(_q_words, w -> xxhash64(w))"))
    # (hash, position) of every window, equal hashes side by side
    q = q.withColumn("_q_windows", F.expr(
        f"sort_array(transform(slice(_q_hash, 1, greatest(size(_q_hash) - {WINDOW - 1}, 0)),"
        "(x, i) -> struct(xxhash64(x, get(_q_hash, i + 1), get(_q_hash, i + 2)) AS h, i AS i)))"))
    q = q.withColumn("_q_again", F.expr(
        "sort_array(transform(filter(_q_windows, (x, i) -> x.h <=> get(_q_windows, i - 1).h"
        " or x.h <=> get(_q_windows, i + 1).h), x -> x.i))"))
    covered = (f"aggregate(_q_again, named_struct('n', 0L, 'last', -{WINDOW}),"
               f"(a, p) -> named_struct('n', a.n + least({WINDOW}, p - a.last), 'last', p), a -> a.n)")
    found = {
        "n_words": F.size("_q_words"),
        "word_chars": F.length(F.array_join("_q_words", "")),
        "n_symbols": F.regexp_count("_q_text", F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size("_q_lines") - F.size(F.array_distinct("_q_lines")),
        "n_repeat_words": F.expr(covered),
    }
    # inline() of one struct: a later filter on these columns is not pushed below, where it would repeat all steps
    measures = F.inline(F.array(F.struct(*(c.cast("long").alias(n) for n, c in found.items()))))
    return q.select(*(c for c in docs.columns if c not in found), measures)


@dataclass(frozen=True)
class Estimate:
    """What a rule costs on the sample, in seconds, and how much of the whole sample it rejects."""

    rule: Rule
    cost: float
    rejected: float


def _seconds(sample: DataFrame, condition: str) -> float:
    best = float("inf")
    for _ in range(RUNS):
        began = time.perf_counter()
        sample.agg(F.count_if(F.expr(condition))).first()
        best = min(best, time.perf_counter() - began)
    return best


def plan(sample: DataFrame, rules: Sequence[Rule]) -> list[Estimate]:
    """The rules in the order of the cascade, from a sample that has the columns they use.

    Only the counts of the combinations of rules that reject a sampled document
    reach the driver, at most one for each document of the sample.
    """
    idle = _seconds(sample, "length(text) < 0")
    cost = {r.name: max(_seconds(sample, r.rejects) - idle, LEAST_COST) for r in rules}
    hits = F.array_compact(F.array(*(F.when(F.expr(r.rejects), F.lit(r.name)) for r in rules)))
    groups = [(set(g.hits), g.n) for g in sample.groupBy(hits.alias("hits")).agg(F.count("*").alias("n")).collect()]
    total = sum(n for _, n in groups) or 1
    alone = {r.name: sum(n for hit, n in groups if r.name in hit) / total for r in rules}
    out, left = [], list(rules)
    while left:
        best = max(left, key=lambda r: (sum(n for hit, n in groups if r.name in hit) / cost[r.name], -cost[r.name]))
        out.append(Estimate(best, cost[best.name], alone[best.name]))
        left.remove(best)
        groups = [(hit, n) for hit, n in groups if best.name not in hit]
    return out


def rejected_by(order: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects a document, null if none does; later rules are not evaluated."""
    if not order:
        return F.lit(None).cast("string")
    first = F.when(F.expr(order[0].rejects), F.lit(order[0].name))
    for rule in order[1:]:
        first = first.when(F.expr(rule.rejects), F.lit(rule.name))
    return first


def sample_of(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """About ``size`` random rows; what is drawn changes costs, never verdicts."""
    return docs.sample(fraction=min(1.0, size / max(docs.count(), 1)), seed=11)


def judge(spark: SparkSession, docs: DataFrame, rules: Sequence[Rule] = RULES,
          base: Sequence[Rule] = BASE_RULES, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with their measures, ``base_failed``, ``rejected_by`` (null if kept or base_failed) and ``kept``.

    Documents that a base rule rejects go through no further rule, in the sample as in the run.
    """
    base_failed = F.coalesce(F.expr(" or ".join(f"({r.rejects})" for r in base) or "false"), F.lit(False))
    own = F.col("text") if "text" in docs.columns else F.lit(None)
    whole = docs.withColumn("_q_given", own).withColumn("text", F.coalesce(F.col(text), F.lit("")))
    drawn = measure(sample_of(whole.select("text"), sample)).where(~base_failed)
    order = [e.rule for e in plan(B.scratch_table(spark, drawn, "quality-sample"), rules)]
    out = (measure(whole).withColumn("base_failed", base_failed)
           .withColumn("rejected_by", F.when(~F.col("base_failed"), rejected_by(order)))
           .withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()))
    return (out.withColumn("text", F.col("_q_given")) if "text" in docs.columns else out.drop("text")).drop("_q_given")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, judged by ``BASE_RULES`` and the cascade of ``RULES``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(spark, docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                     "base_failed", "kept")


ORACLE = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
           FROM documents),
t AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT r, i, w, lead(w, 1) OVER (PARTITION BY r ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY r ORDER BY i) AS w3 FROM t),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM g WHERE w3 IS NOT NULL),
p AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY r),
m AS (SELECT d.*, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(lines) AS n_lines,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN p USING (r)),
b AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (
           word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words OR (n_dup_lines > 1 AND 10 * n_dup_lines > 3 * n_lines)
           OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣◦⁃]'))) > 9 * n_lines
           OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 3 * n_lines
           OR 10 * len(regexp_extract_all(text, '[^\x20\x09-\x0D]*\p{{L}}[^\x20\x09-\x0D]*')) < 7 * n_words) AS kept
FROM b
"""
