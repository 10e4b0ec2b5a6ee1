"""Chunks built straight from one-row-per-comment tables (skew-safe D5-D7).

When comments arrive as separate rows (a conversation table, a journal
export), an issue never has to be gathered into one row to be chunked:

* per-issue facts (first comment, last role, counts) are partial
  aggregates;
* noted comments are ranked inside their issue with a skew-safe rank;
* every chunk gathers at most ``journals_per_chunk`` lines.

An issue holding a third of all comments is therefore spread over many
tasks.  The result equals ``documents.prepare_chunks`` on the nested issue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.functions.pii import scrub_pii
from issuelens.functions.text import first_line, id_text, non_empty, or_empty, py_strip, truncate
from issuelens.operators.anonymize import anonymous_name
from issuelens.operators.ordering import with_key_rank, with_key_running_sum
from issuelens.sources.adapters import ROLE_USER_IDS, _lookup, _project_of, priority_of


def _display_name(role, anonymize: bool):
    uid = _lookup(role, ROLE_USER_IDS).cast("bigint")
    plain = F.when(non_empty(role), role).otherwise(F.lit(C.UNKNOWN_USER))
    if not anonymize:
        return plain
    return F.when(uid.isNotNull(), anonymous_name(uid)).otherwise(plain)


def conversation_chunks(turns: DataFrame, journals_per_chunk: int = C.JOURNALS_PER_CHUNK,
                        max_text_len: int | None = C.MAX_TEXT_LEN, anonymize: bool = True) -> DataFrame:
    """Chunks of the conversation issues, from ``conv_id, turn, role, text`` rows; no issue is gathered into one row."""
    t = turns.select("conv_id", "turn", "role", "text")
    facts = t.groupBy("conv_id").agg(
        F.min("turn").alias("t0"),
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("role", "text"), F.col("turn")).alias("first"),
        F.max_by(F.col("role"), F.col("turn")).alias("last_role"),
    )
    desc = F.col("first.text")
    if anonymize:
        desc = scrub_pii(desc)
    author_uid = _lookup(F.col("first.role"), ROLE_USER_IDS).cast("bigint")
    author = F.col("first.role")
    if anonymize:
        author = F.when(author_uid.isNotNull(), anonymous_name(author_uid)).otherwise(author)
    project = _project_of(F.col("conv_id"))
    meta = facts.select(
        "conv_id", "t0",
        first_line(F.col("first.text")).alias("_subject"),
        desc.alias("_description"),
        id_text("conv_id").alias("issue_id"),
        F.substring(or_empty(first_line(F.col("first.text"))), 1, C.SUBJECT_META_LEN).alias("subject"),
        F.when(F.col("last_role") == "assistant", F.lit("Resolved")).otherwise(F.lit("New")).alias("status"),
        priority_of(F.col("conv_id")).alias("priority"), F.lit("Support").alias("tracker"),
        project.alias("project"), project.alias("project_id"),
        F.lit("").alias("created_on"), F.lit("").alias("updated_on"),
        F.when(non_empty(author), author).otherwise(F.lit("")).alias("author"),
        F.lit("").alias("assigned_to"),
        (F.col("n") - 1).cast("bigint").alias("num_journals"),
    )
    meta_cols = ["issue_id", "subject", "status", "priority", "tracker", "project", "project_id",
                 "created_on", "updated_on", "author", "assigned_to", "num_journals"]

    # chunk 0 per issue
    head = F.concat_ws("\n", F.concat(F.lit("Subject: "), or_empty("_subject")),
                       F.when(non_empty("_description"), F.concat(F.lit("Description: "), F.col("_description"))))
    chunk0 = meta.select(
        F.concat(F.lit("issue_"), F.col("issue_id")).alias("id"),
        truncate(py_strip(head), max_text_len).alias("text"), *meta_cols,
        F.lit(0).alias("chunk_index"), F.lit(True).alias("is_description"))

    # noted later comments, ranked inside their issue (skew-safe)
    later = (t.join(meta.select("conv_id", "t0"), "conv_id")
             .where((F.col("turn") > F.col("t0")) & non_empty("text")))
    note = scrub_pii("text") if anonymize else F.col("text")
    later = later.select("conv_id", "turn",
                         F.concat(F.lit("- "), _display_name(F.col("role"), anonymize), F.lit(": "), note).alias("line"))
    ranked = with_key_rank(later, "conv_id", ["turn"], "r")
    grouped = (ranked.withColumn("chunk_index", (F.floor((F.col("r") - 1) / journals_per_chunk) + 1).cast("int"))
               .groupBy("conv_id", "chunk_index")
               .agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("ls")))   # <= journals_per_chunk rows
    body = F.array_join(F.transform("ls", lambda x: x.getField("line")), "\n")
    rest = grouped.join(meta, "conv_id").select(
        F.concat(F.lit("issue_"), F.col("issue_id"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("id"),
        truncate(F.concat(F.lit("Subject: "), or_empty("_subject"), F.lit("\nComments:\n"), body),
                 max_text_len).alias("text"),
        *meta_cols, "chunk_index", F.lit(False).alias("is_description"))
    return chunk0.unionByName(rest)


def conversation_documents(turns: DataFrame, max_text_len: int = C.MAX_TEXT_LEN,
                           anonymize: bool = False) -> DataFrame:
    """D3 from comment rows: one truncated document per issue, bounded work.

    Of an issue's noted comments only those that begin within the first
    ``max_text_len`` characters can reach the truncated text, and only they
    are gathered, whole.  If others follow, a non-blank mark stands for them,
    so that the strip does not reach back past the cut.
    """
    t = turns.select("conv_id", "turn", "role", "text")
    facts = t.groupBy("conv_id").agg(
        F.min("turn").alias("t0"), F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("role", "text"), F.col("turn")).alias("first"))
    desc = scrub_pii(F.col("first.text")) if anonymize else F.col("first.text")
    later = (t.join(facts.select("conv_id", "t0"), "conv_id")
             .where((F.col("turn") > F.col("t0")) & non_empty("text")))
    note = scrub_pii("text") if anonymize else F.col("text")
    line = F.concat(F.lit("- "), _display_name(F.col("role"), anonymize), F.lit(": "), note)
    sized = later.select("conv_id", "turn", line.alias("line"), (F.length(line) + 1).cast("bigint").alias("_size"))
    placed = with_key_running_sum(sized, "conv_id", ["turn"], "_size", "r", "_to")
    begins = F.col("_to") - F.col("_size") <= max_text_len
    lines = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(begins, F.struct("r", "line")))).alias("ls"),
        F.count(F.lit(1)).alias("_lines"))
    comments = F.concat(F.array_join(F.transform("ls", lambda x: x.getField("line")), "\n"),
                        F.when(F.size("ls") < F.col("_lines"), F.lit("\n- ")).otherwise(F.lit("")))
    j = facts.join(lines, "conv_id", "left")
    head = F.concat_ws(
        "\n", F.concat(F.lit("Subject: "), or_empty(first_line(F.col("first.text")))),
        F.when(non_empty(desc), F.concat(F.lit("Description: "), desc)),
        F.when(F.col("ls").isNotNull() & (F.size("ls") > 0), F.concat(F.lit("Comments:\n"), comments)))
    return j.select(
        F.concat(F.lit("issue_"), id_text("conv_id")).alias("id"),
        truncate(py_strip(head), max_text_len).alias("text"),
        id_text("conv_id").alias("issue_id"),
        (F.col("n") - 1).cast("bigint").alias("num_journals"))


def join_ranked(lines: DataFrame, key: str, rank_col: str, line_col: str, sep: str,
                block: int = 1000) -> DataFrame:
    """``key, joined``: lines joined in rank order, in two bounded levels.

    Level one joins blocks of ``block`` consecutive ranks (bounded groups);
    level two joins the block strings of a key.  No group ever collects a
    key's raw rows; only the output string itself is per key.
    """
    b = (F.floor((F.col(rank_col) - 1) / block)).cast("bigint")
    blocks = (lines.groupBy(key, b.alias("_b"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank_col, line_col))),
                                            lambda x: x.getField(line_col)), sep).alias("_t")))
    return (blocks.groupBy(key)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_t"))),
                                          lambda x: x.getField("_t")), sep).alias("joined")))


def conversation_journal_text(turns: DataFrame) -> DataFrame:
    """D2 per issue: ``issue_id`` (conv id), ``comments``."""
    t = turns.select("conv_id", "turn", "role", "text")
    t0 = t.groupBy("conv_id").agg(F.min("turn").alias("t0"))
    noted = (t.join(t0, "conv_id").where((F.col("turn") > F.col("t0")) & non_empty("text"))
             .select("conv_id", "turn", F.concat(F.lit("- "), _display_name(F.col("role"), False),
                                                 F.lit(": "), F.col("text")).alias("line")))
    joined = join_ranked(with_key_rank(noted, "conv_id", ["turn"], "r"), "conv_id", "r", "line", "\n")
    return (t0.join(joined, "conv_id", "left")
            .select(F.col("conv_id").alias("issue_id"), F.coalesce("joined", F.lit("")).alias("comments")))


def conversation_user_lists(turns: DataFrame) -> DataFrame:
    """A3-A6 + A12 flattened per issue: author, journal users, scrubbed notes, description."""
    t = turns.select("conv_id", "turn", "role", "text")
    facts = t.groupBy("conv_id").agg(F.min("turn").alias("t0"),
                                     F.min_by(F.struct("role", "text"), F.col("turn")).alias("first"))
    uid = _lookup(F.col("role"), ROLE_USER_IDS).cast("bigint")
    later = (t.join(facts.select("conv_id", "t0"), "conv_id").where(F.col("turn") > F.col("t0"))
             .select("conv_id", "turn",
                     F.coalesce(F.when(uid.isNotNull(), anonymous_name(uid)).otherwise(F.col("role")),
                                F.lit("")).alias("u"),
                     F.coalesce(scrub_pii("text"), F.lit("")).alias("note")))
    ranked = with_key_rank(later, "conv_id", ["turn"], "r")
    users = join_ranked(ranked, "conv_id", "r", "u", ",").withColumnRenamed("joined", "journal_users")
    notes = join_ranked(ranked, "conv_id", "r", "note", "\n").withColumnRenamed("joined", "notes")
    auid = _lookup(F.col("first.role"), ROLE_USER_IDS).cast("bigint")
    return (facts.join(users, "conv_id", "left").join(notes, "conv_id", "left")
            .select(F.col("conv_id").alias("issue_id"),
                    F.when(auid.isNotNull(), anonymous_name(auid)).otherwise(F.col("first.role")).alias("author_name"),
                    F.coalesce("journal_users", F.lit("")).alias("journal_users"),
                    F.coalesce("notes", F.lit("")).alias("notes"),
                    scrub_pii(F.col("first.text")).alias("description")))
