"""Issue -> document and issue -> chunks.

Every step is a narrow projection: the journals of an issue already live in
the issue row, so chunking is array work inside the row followed by one
``explode`` and never needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.functions.text import id_text, name_of, non_empty, or_empty, py_strip, truncate


def metadata_columns(subject_len: int = C.SUBJECT_META_LEN, journal_count: Column | None = None) -> list[Column]:
    """The 12 metadata fields shared by every chunk of an issue.

    ``journal_count`` replaces ``size(journals)`` for issue rows that carry
    a count instead of the journal array.
    """
    return [
        id_text("id").alias("issue_id"),
        F.substring(or_empty("subject"), 1, subject_len).alias("subject"),
        name_of("status").alias("status"),
        name_of("priority").alias("priority"),
        name_of("tracker").alias("tracker"),
        name_of("project").alias("project"),
        F.when(non_empty("project_identifier"), F.col("project_identifier"))
         .otherwise(F.lit("")).alias("project_id"),
        F.when(non_empty("created_on"), F.col("created_on")).otherwise(F.lit("")).alias("created_on"),
        F.when(non_empty("updated_on"), F.col("updated_on")).otherwise(F.lit("")).alias("updated_on"),
        name_of("author").alias("author"),
        name_of("assigned_to").alias("assigned_to"),
        (journal_count if journal_count is not None
         else F.size(F.coalesce(F.col("journals"), F.array()))).cast("bigint").alias("num_journals"),
    ]


CHUNK_ARRAY_TYPE = "array<struct<id:string,text:string,chunk_index:int,is_description:boolean>>"

META_NAMES = ["issue_id", "subject", "status", "priority", "tracker", "project", "project_id",
              "created_on", "updated_on", "author", "assigned_to", "num_journals"]


def noted_journals(journals: Column) -> Column:
    """Journals with non-empty notes, in their original order."""
    return F.filter(F.coalesce(journals, F.array()), lambda j: non_empty(j.getField("notes")))


def journal_lines(journals: Column) -> Column:
    """``- {user}: {notes}`` per noted journal, joined by newlines."""
    lines = F.transform(
        noted_journals(journals),
        lambda j: F.concat(F.lit("- "), name_of(j.getField("user"), C.UNKNOWN_USER),
                           F.lit(": "), j.getField("notes")),
    )
    return F.array_join(lines, "\n")


def _head_text() -> Column:
    """``Subject: s`` plus ``Description: d`` when the description is set."""
    subj = F.concat(F.lit("Subject: "), or_empty("subject"))
    desc = F.when(non_empty("description"), F.concat(F.lit("Description: "), F.col("description")))
    return F.concat_ws("\n", subj, desc)


def prepare(issues: DataFrame, max_text_len: int = C.MAX_TEXT_LEN) -> DataFrame:
    """D3: one document per issue (``id, text`` + metadata)."""
    comments = journal_lines(F.col("journals"))
    body = F.concat_ws(
        "\n", _head_text(),
        F.when(F.length(comments) > 0, F.concat(F.lit("Comments:\n"), comments)),
    )
    text = truncate(py_strip(body), max_text_len)
    return issues.select(
        F.concat(F.lit("issue_"), id_text("id")).alias("id"),
        text.alias("text"),
        *metadata_columns(),
    )


def chunk_structs(journals_per_chunk: int, max_text_len: int) -> Column:
    """D5 + D6 as one array of ``struct(id, text, chunk_index, is_description)``.

    Reads the helper columns ``_lines`` (rendered noted journals), ``_iid``
    and ``_subject_head`` that ``prepare_chunks`` adds.
    """
    iid = F.col("_iid")
    first = F.struct(
        F.concat(F.lit("issue_"), iid).alias("id"),
        truncate(py_strip(_head_text()), max_text_len).alias("text"),
        F.lit(0).alias("chunk_index"),
        F.lit(True).alias("is_description"),
    )
    # per-issue pieces as columns (see prepare_chunks): the lambda below
    # then reads attributes instead of re-evaluating them for every chunk
    noted = F.col("_lines")
    n_chunks = F.ceil(F.size(noted) / F.lit(journals_per_chunk)).cast("int")
    subject_head = F.col("_subject_head")

    def one(i: Column) -> Column:
        piece = F.slice(noted, i * journals_per_chunk + 1, F.lit(journals_per_chunk))
        lines = F.array_join(piece, "\n")
        return F.struct(
            F.concat(F.lit("issue_"), F.col("_iid"), F.lit("_chunk_"), (i + 1).cast("string")).alias("id"),
            truncate(F.concat(subject_head, lines), max_text_len).alias("text"),
            (i + 1).cast("int").alias("chunk_index"),
            F.lit(False).alias("is_description"),
        )

    # sequence(0, -1) raises, so issues without noted journals skip it
    rest = F.when(n_chunks > 0, F.transform(F.sequence(F.lit(0), n_chunks - 1), one)) \
        .otherwise(F.array().cast(CHUNK_ARRAY_TYPE))
    return F.concat(F.array(first), rest)


def prepare_chunks(issues: DataFrame, journals_per_chunk: int = C.JOURNALS_PER_CHUNK,
                   max_text_len: int | None = C.CHUNK_MAX_TEXT_LEN) -> DataFrame:
    """Issue -> chunk rows (at least one per issue)."""
    # chunk array first: its expressions read the raw subject/id columns,
    # which the metadata projection re-uses as output names
    # explode_outer: the array always holds chunk 0, and a plain explode
    # makes the optimizer add a size(array) > 0 filter that re-evaluates
    # the whole chunk expression (scrub, strip, truncate) a second time
    lines = F.transform(noted_journals(F.col("journals")),
                        lambda j: F.concat(F.lit("- "), name_of(j.getField("user"), C.UNKNOWN_USER),
                                           F.lit(": "), j.getField("notes")))
    with_chunks = (issues
                   .withColumn("_lines", lines)
                   .withColumn("_iid", id_text("id"))
                   .withColumn("_subject_head", F.concat(F.lit("Subject: "), or_empty("subject"),
                                                         F.lit("\nComments:\n")))
                   .withColumn("_chunks", chunk_structs(journals_per_chunk, max_text_len)))
    exploded = with_chunks.select(*metadata_columns(), F.explode_outer("_chunks").alias("c"))
    return exploded.select(
        F.col("c.id").alias("id"), F.col("c.text").alias("text"), *META_NAMES,
        F.col("c.chunk_index").alias("chunk_index"),
        F.col("c.is_description").alias("is_description"),
    )


def expansion_counts(chunks: DataFrame) -> DataFrame:
    """Issues, chunks and chunks per issue."""
    return chunks.agg(
        F.countDistinct("issue_id").alias("n_issues"),
        F.count(F.lit(1)).alias("n_chunks"),
    ).select("n_issues", "n_chunks",
             F.round(F.col("n_chunks") / F.nullif(F.col("n_issues"), F.lit(0)), 6).alias("chunks_per_issue"))


def embed_windows(chunks: DataFrame, size: int = C.EMBED_MAX_CHARS) -> DataFrame:
    """Chunks as consecutive windows of what the embedder takes, so that no text stays unembedded.

    Adds ``chunk_id``, ``part`` (from 0) and ``window``, the text to embed.
    The first window keeps the chunk's id and its whole text; window n gets the
    id ``<id>_part_<n>`` and no text; the other columns are repeated.
    """
    n = f"greatest(0, (length(text) - 1) div {size})"
    cut = (f"transform(sequence(0, {n}), i -> named_struct('part', i,"
           f" 'window', substring(text, cast(i * {size} + 1 as int), {size}), 'whole', if(i = 0, text, null)))")
    part = F.col("_w.part").cast("int")
    parts = chunks.withColumn("_w", F.explode(F.expr(cut)))
    return (parts.withColumn("chunk_id", F.col("id")).withColumn("part", part)
            .withColumn("window", F.col("_w.window")).withColumn("text", F.col("_w.whole"))
            .withColumn("id", F.when(part == 0, F.col("chunk_id")).otherwise(
                F.concat("chunk_id", F.lit("_part_"), part.cast("string"))))
            .drop("_w"))
