"""Question filters: prompt, response parsing, validation, predicates.

All steps are column expressions on the question DataFrame; the alias
table is a literal map (22 entries), so no join is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.functions.text import col_, py_strip

RAW_FIELDS = "status: string, priority: string, project: string"
FENCE = "```"


def extraction_prompt(question: Column | str) -> Column:
    """The filter-extraction prompt for each question."""
    return F.concat(F.lit(C.FILTER_EXTRACTION_PROMPT), col_(question), F.lit(C.FILTER_EXTRACTION_SUFFIX))


def unfence(response: Column | str) -> Column:
    """Strip; if fenced, keep the part between the first two fences minus a ``json`` tag."""
    raw = py_strip(F.coalesce(col_(response), F.lit("")))
    inner = F.coalesce(F.get(F.split(raw, "```"), 1), F.lit(""))
    inner = F.when(inner.startswith("json"), F.substring(inner, 5, 1 << 30)).otherwise(inner)
    return F.when(raw.startswith(FENCE), inner).otherwise(raw)


JSON_STRING = r'"(?:[^"\\]|\\.)*"'


def one_value(body: Column) -> Column:
    """Whether the first bracket of a text closes with its last character.

    Without its strings the text is walked bracket by bracket; the depth must
    not return to zero before the end.
    """
    brackets = F.split(F.regexp_replace(F.regexp_replace(py_strip(body), JSON_STRING, ""), r"[^\[\]{}]", "."), "")
    deep = F.aggregate(
        brackets, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed")),
        lambda a, c: F.struct(
            (a.depth + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)).alias("depth"),
            (a.closed + F.when((a.depth <= 0) & (c != ""), 1).otherwise(0)).alias("closed")))
    # only the first character meets depth zero
    return (deep.depth == 0) & (deep.closed == 1)


def parse_response(response: Column | str) -> Column:
    """R2: raw ``struct(status, priority, project)``; anything but an object gives NULLs.

    Strict JSON: single quotes and other lenient forms are rejected, and so
    is anything but white space around the object.  The parser stops after
    the first value it reads, so the object also has to be the only one: as
    the one element of an array, and with no bracket that closes it early.
    """
    body = unfence(response)
    is_object = py_strip(body).startswith("{") & one_value(body)
    parsed = F.from_json(F.concat(F.lit("["), body, F.lit("]")), f"array<struct<{RAW_FIELDS}>>",
                         {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    return F.when(is_object & (F.size(parsed) == 1), F.get(parsed, 0))


def _alias_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in C.PROJECT_ALIASES.items() for x in kv])


def validate(raw: Column) -> Column:
    """R3 + R4: known status/priority (exact case), project alias -> canonical id."""
    status = raw.getField("status")
    priority = raw.getField("priority")
    project = F.lower(py_strip(raw.getField("project")))
    return F.struct(
        F.when(status.isin(*C.KNOWN_STATUSES), status).alias("status"),
        F.when(priority.isin(*C.KNOWN_PRIORITIES), priority).alias("priority"),
        _alias_map()[project].alias("project_id"),
    )


def extract_filters(questions: DataFrame, response_col: str = "response") -> DataFrame:
    """Add validated ``status, priority, project_id`` (NULL = no filter) columns."""
    v = validate(parse_response(response_col))
    return (questions.withColumn("_f", v)
            .withColumn("status", F.col("_f.status"))
            .withColumn("priority", F.col("_f.priority"))
            .withColumn("project_id", F.col("_f.project_id"))
            .drop("_f"))


def predicate(filters: dict[str, str] | None) -> Column | None:
    """Conjunction of equalities; None when there is no filter."""
    if not filters:
        return None
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in filters.items()])


def filters_map(status: Column, priority: Column, project_id: Column) -> Column:
    """Applied filters as ``map<string,string>`` without the unset keys."""
    entries = F.array(
        F.struct(F.lit("status").alias("k"), status.alias("v")),
        F.struct(F.lit("priority").alias("k"), priority.alias("v")),
        F.struct(F.lit("project_id").alias("k"), project_id.alias("v")),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e.getField("v").isNotNull()))


# ---------------------------------------------------------------------------
# Offline stand-in for the chat model's filter extraction
# ---------------------------------------------------------------------------

WORD_EDGE_L = r"(?:^|[^\p{L}\p{N}_])"
WORD_EDGE_R = r"(?:[^\p{L}\p{N}_]|$)"


def word_pattern(word: str) -> str:
    """Case-insensitive whole-word match with engine-neutral boundaries."""
    import re
    return "(?i)" + WORD_EDGE_L + re.escape(word).replace("\\ ", " ") + WORD_EDGE_R


def _first_word(text: Column, words, values=None) -> Column:
    values = values or words
    out = F.lit(None).cast("string")
    for w, v in reversed(list(zip(words, values))):
        out = F.when(text.rlike(word_pattern(w)), F.lit(v)).otherwise(out)
    return out


def keyword_response(question: Column | str) -> Column:
    """A deterministic responder for runs without a model server.

    It answers the extraction prompt the way the model is asked to: a fenced
    JSON object holding the first known status, priority and project alias
    named in the question (list order), or ``{}``.
    """
    q = col_(question)
    aliases = list(C.PROJECT_ALIASES.keys())
    obj = F.to_json(F.struct(
        _first_word(q, C.KNOWN_STATUSES).alias("status"),
        _first_word(q, C.KNOWN_PRIORITIES).alias("priority"),
        _first_word(q, aliases).alias("project"),
    ))
    return F.concat(F.lit("```json\n"), obj, F.lit("\n```"))
