"""Anonymisation of user objects and free text.

The anonymous name depends on the user id alone, so replacing user objects
is a projection with no join.  The mapping table (first-seen original name
per id) is one aggregation whose ``min_by`` is partially aggregated before
the shuffle, so a user who appears in a third of all issues still sends at
most one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.functions.pii import pii_matches, scrub_pii
from issuelens.functions.text import non_empty

USER_REF_TYPE = "array<struct<role_rank:int,idx:int,user:struct<id:bigint,name:string>>>"


def anonymous_name(user_id: Column | str) -> Column:
    """A1: ``User_`` + id zero-padded to at least 5 digits (NULL stays NULL)."""
    uid = F.col(user_id) if isinstance(user_id, str) else user_id
    return F.when(uid.isNotNull(), F.format_string(C.ANON_NAME_FORMAT, uid))


def anonymize_user(u: Column, strict: bool = False) -> Column:
    """A3: ``{id, User_xxxxx}``; NULL or id-less objects are returned as they are.

    With ``strict`` an id-less object keeps no name either (``Unknown``).
    """
    keep = u
    if strict:
        keep = F.when(u.isNotNull(), F.struct(u.getField("id").alias("id"),
                                              F.lit(C.UNKNOWN_USER).alias("name")))
    return F.when(u.isNotNull() & u.getField("id").isNotNull(),
                  F.struct(u.getField("id").alias("id"),
                           anonymous_name(u.getField("id")).alias("name"))).otherwise(keep)


def anonymize_issues(issues: DataFrame, scrub: bool = True, strict: bool = False) -> DataFrame:
    """A4-A6 and A12 on an issue DataFrame; other columns pass through.

    ``strict`` (off by default, as in the reference) also masks the names of
    id-less user objects and scrubs the subject.
    """
    def journal(j: Column) -> Column:
        notes = j.getField("notes")
        return F.struct(
            j.getField("id").alias("id"),
            anonymize_user(j.getField("user"), strict).alias("user"),
            (scrub_pii(notes) if scrub else notes).alias("notes"),
            j.getField("created_on").alias("created_on"),
        )

    out = (issues
           .withColumn("author", anonymize_user(F.col("author"), strict))
           .withColumn("assigned_to", anonymize_user(F.col("assigned_to"), strict))
           .withColumn("journals", F.transform("journals", journal))
           .withColumn("watchers", F.transform("watchers", lambda w: anonymize_user(w, strict))))
    if scrub:
        out = out.withColumn("description", scrub_pii("description"))
    if strict:
        out = out.withColumn("subject", scrub_pii("subject"))
    return out


def user_refs(issues: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Every user reference with its position: (seq, role_rank, idx, user).

    Order inside an issue: author, assigned_to, journals, watchers.
    """
    refs = F.concat(
        F.array(F.struct(F.lit(0).alias("role_rank"), F.lit(0).alias("idx"), F.col("author").alias("user"))),
        F.array(F.struct(F.lit(1).alias("role_rank"), F.lit(0).alias("idx"), F.col("assigned_to").alias("user"))),
        F.transform(F.coalesce("journals", F.array()),
                    lambda j, i: F.struct(F.lit(2).alias("role_rank"), i.alias("idx"),
                                          j.getField("user").alias("user"))),
        F.transform(F.coalesce("watchers", F.array()),
                    lambda w, i: F.struct(F.lit(3).alias("role_rank"), i.alias("idx"), w.alias("user"))),
    ).cast(USER_REF_TYPE)
    # explode_outer + NULL filter: avoids an inferred size() filter that
    # would build the reference array twice
    return (issues.select(F.col(seq_col).alias("seq"), F.explode_outer(refs).alias("r"))
            .select("seq", "r.role_rank", "r.idx", "r.user")
            .where(F.col("user").isNotNull() & F.col("user.id").isNotNull()))


def user_mapping(issues: DataFrame, seq_col: str = "seq") -> DataFrame:
    """A2: ``user_id, original_name, anonymous_name``; first-seen name wins."""
    return mapping_from_refs(user_refs(issues, seq_col))


def mapping_from_refs(refs: DataFrame) -> DataFrame:
    """A2 over reference rows ``seq, role_rank, idx, user`` from any source."""
    original = F.when(non_empty(F.col("user.name")), F.col("user.name")).otherwise(F.lit(C.UNKNOWN_USER))
    return (refs.groupBy(F.col("user.id").alias("user_id"))
            .agg(F.min_by(original, F.struct("seq", "role_rank", "idx")).alias("original_name"))
            .select("user_id", "original_name", anonymous_name("user_id").alias("anonymous_name")))


def pii_audit(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """One row per redacted match: key, stage, kind, match, replacement."""
    # explode_outer + NULL filter: a plain explode gets an inferred
    # size() filter that runs every regex stage twice
    return (df.select(F.col(key), F.explode_outer(pii_matches(text_col)).alias("m"))
            .where(F.col("m").isNotNull())
            .select(key, "m.stage", "m.kind", "m.match", "m.replacement"))


def run_summary(issues: DataFrame, mapping: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Issues processed, distinct users, first issue's author before/after."""
    first_author = issues.agg(
        F.count(F.lit(1)).alias("issues_processed"),
        F.min_by(F.col("author.name"), F.col(seq_col)).alias("sample_author_before"),
        F.min_by(anonymize_user(F.col("author")).getField("name"), F.col(seq_col)).alias("sample_author_after"),
        F.lit(None).cast("bigint").alias("distinct_users"),
    )
    users = mapping.agg(
        F.lit(None).cast("bigint").alias("issues_processed"),
        F.lit(None).cast("string").alias("sample_author_before"),
        F.lit(None).cast("string").alias("sample_author_after"),
        F.count(F.lit(1)).alias("distinct_users"),
    )
    # two one-row aggregates folded into one row (no join needed)
    both = first_author.unionByName(users)
    return both.agg(*[F.max(c).alias(c) for c in
                      ("issues_processed", "distinct_users", "sample_author_before", "sample_author_after")])
