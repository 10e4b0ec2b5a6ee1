"""Incremental load, upsert and set operations.

Upserts and key dedups are one ``groupBy(key)`` with ``max_by``/``min``:
both are partially aggregated before the shuffle, so a hot key (one issue
updated a billion times) costs one row per map task in the exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens import config as C
from issuelens.functions.pii import java_pattern
from issuelens.functions.text import elapsed_seconds, non_empty

ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def changed_since(versions: DataFrame, since: str, ts_col: str = "updated_ts") -> DataFrame:
    """M1: rows updated at or after ``since`` (a date or a datetime, inclusive).

    A malformed ``since`` parses to NULL and selects nothing.  The
    predicate is on the scan column, so it reaches the parquet reader.
    """
    bound = F.try_to_timestamp(F.lit(since))
    return versions.where(F.col(ts_col) >= bound)


def resolve_since(state: DataFrame, project_ids: Sequence[str]) -> DataFrame:
    """M2: earliest non-empty ``last_synced_at`` over the chosen projects (1 row)."""
    return (state.where(F.col("project_id").isin(*project_ids) & non_empty("last_synced_at"))
            .agg(F.min("last_synced_at").alias("since")))


def resolve_since_value(state: DataFrame, project_ids: Sequence[str]) -> str:
    row = resolve_since(state, project_ids).first()
    if row is None or row["since"] is None:
        raise ValueError("sync needs a previous sync state; run with an explicit since date first")
    return row["since"]


def latest(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Of each key the row of the greatest ``order``; the rows lie by key, so that a join by it need not move them."""
    cols = df.columns
    return (df.groupBy(key)
            .agg(F.max_by(F.struct(*[F.col(c) for c in cols]), order).alias("_r"))
            .select(*[F.col(c) if c == key else F.col("_r").getField(c).alias(c) for c in cols]))


def merge_upsert(existing: DataFrame, incoming: DataFrame, key: str = "id",
                 seq_col: str = "seq") -> DataFrame:
    """M3: incoming rows replace existing rows with the same key.

    Within the incoming batch the row with the greatest ``seq`` wins, as a
    sequential dict assignment would leave it.
    """
    both = (existing.withColumn("_src", F.lit(0))
            .unionByName(incoming.withColumn("_src", F.lit(1))))
    out = latest(both, key, F.struct(F.col("_src"), F.col(seq_col)))
    return out.drop("_src")


def merge_counts(existing: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """M3 counts: ``n_new`` distinct incoming keys not yet present, the rest updated.

    A key that is new and appears twice in the batch counts once as new and
    once as updated, as in a sequential merge.
    """
    in_keys = incoming.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    new_keys = in_keys.join(existing.select(key).distinct(), key, "left_anti")
    total = in_keys.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"))
    fresh = new_keys.agg(F.count(F.lit(1)).alias("n_new"))
    both = (total.select(F.col("rows"), F.lit(None).cast("bigint").alias("n_new"))
            .unionByName(fresh.select(F.lit(None).cast("bigint").alias("rows"), F.col("n_new"))))
    agg = both.agg(F.max("rows").alias("rows"), F.max("n_new").alias("n_new"))
    return agg.select(F.col("n_new").cast("bigint").alias("n_new"),
                      (F.col("rows") - F.col("n_new")).cast("bigint").alias("n_updated"))


def dedup_last(df: DataFrame, key: str = "id", seq_col: str = "seq") -> DataFrame:
    """M5: one row per key, the **last** value wins, the **first** position is kept.

    ``first_seq`` is the position a dict built in order would list it at.
    """
    cols = [c for c in df.columns]
    return (df.groupBy(key)
            .agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(seq_col)).alias("_r"),
                 F.min(seq_col).alias("first_seq"))
            .select(*[F.col("_r").getField(c).alias(c) for c in cols], "first_seq"))


def project_union(df: DataFrame, project_ids: Sequence[str],
                  project_col: str = "project_identifier") -> DataFrame:
    """M4: rows of the listed projects with their project's position.

    One scan with an ``IN`` filter (pushed to parquet) instead of one read
    per project; ``project_rank`` reproduces the concatenation order.
    """
    order = F.array(*[F.lit(p) for p in project_ids])
    return (df.where(F.col(project_col).isin(*project_ids))
            .withColumn("project_rank", F.array_position(order, F.col(project_col))))


def journal_count(issues: DataFrame) -> Column:
    """Journals per issue: the ``n_journals`` column when present, else the array size."""
    if "n_journals" in issues.columns:
        return F.coalesce(F.col("n_journals"), F.lit(0))
    return F.coalesce(F.size("journals"), F.lit(0))


def journals_only(issues: DataFrame, projects: Sequence[str] = C.JOURNALS_ONLY_PROJECTS,
                  project_col: str = "project_identifier", mode: str = "full") -> DataFrame:
    """M6: in the listed projects keep only issues that have journals.

    Applied on full loads only; an incremental sync (``mode="incremental"``)
    keeps every changed issue, as the reference's sync does.
    """
    if mode == "incremental":
        return issues
    has = journal_count(issues) > 0
    listed = F.coalesce(F.col(project_col).isin(*projects), F.lit(False)) if projects else F.lit(False)
    return issues.where(~listed | has)


def missing_journals(issues: DataFrame) -> DataFrame:
    """M7: issues with NULL or empty journals."""
    return issues.where(journal_count(issues) <= 0)


def enrich_overlay(bulk: DataFrame, enriched: DataFrame, key: str = "id") -> DataFrame:
    """M8: the fetched full record replaces the bulk row when one was found."""
    cols = bulk.columns
    e = enriched.select(F.col(key).alias("_ek"),
                        F.struct(*[F.col(c) for c in cols]).alias("_e"))
    j = bulk.join(e, bulk[key] == e["_ek"], "left")
    return j.select(*[F.when(F.col("_ek").isNotNull(), F.col("_e").getField(c))
                      .otherwise(F.col(c)).alias(c) for c in cols])


def journal_coverage(issues: DataFrame, group_col: str | None = None) -> DataFrame:
    """M9: issues with journals / all issues, and the percentage."""
    has = journal_count(issues) > 0
    g = issues.groupBy(group_col) if group_col else issues.groupBy()
    return (g.agg(F.count_if(has).alias("with_journals"), F.count(F.lit(1)).alias("total"))
            .withColumn("pct", F.round(F.col("with_journals") * 100.0
                                       / F.nullif(F.col("total"), F.lit(0)), 6)))


def resume_pending(candidates: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Ids not yet done (anti join to the done-set)."""
    return candidates.join(done.select(key).distinct(), key, "left_anti")


def completeness(done: DataFrame, totals: DataFrame, project_col: str = "project_id") -> DataFrame:
    """A project is complete when done >= total (not ==)."""
    d = done.groupBy(project_col).agg(F.countDistinct("id").alias("done"))
    return (totals.join(d, project_col, "left")
            .select(project_col, F.coalesce("done", F.lit(0)).alias("done"), "total",
                    (F.coalesce("done", F.lit(0)) >= F.col("total")).alias("complete")))


def advance_sync_state(state: DataFrame, synced: DataFrame, run_started_at: str) -> DataFrame:
    """``last_synced_at`` := run start, ``sync_count`` + 1, for synced projects only.

    ``synced`` holds the ``project_id`` of every project the run completed;
    other projects keep their state untouched.
    """
    s = synced.select("project_id").distinct().withColumn("_hit", F.lit(True))
    j = state.join(s, "project_id", "full_outer")
    return j.select(
        "project_id",
        F.when(F.col("_hit"), F.lit(run_started_at)).otherwise(F.col("last_synced_at")).alias("last_synced_at"),
        F.when(F.col("_hit"), F.coalesce(F.col("sync_count"), F.lit(0)) + 1)
         .otherwise(F.col("sync_count")).cast("int").alias("sync_count"),
    )


def load_progress(log: DataFrame, totals: DataFrame, project_col: str = "project_id",
                  ts_col: str = "ts") -> DataFrame:
    """done/total percent, rate (items/s) and remaining per project."""
    d = log.groupBy(project_col).agg(
        F.count(F.lit(1)).alias("done"),
        elapsed_seconds(F.max(ts_col), F.min(ts_col)).alias("elapsed"))
    j = totals.join(d, project_col, "left")
    done = F.coalesce("done", F.lit(0))
    return j.select(
        project_col, done.alias("done"), "total",
        F.round(done * 100.0 / F.nullif(F.col("total"), F.lit(0)), 6).alias("pct"),
        F.round(F.when(F.col("elapsed") > 0, done / F.col("elapsed")).otherwise(F.lit(0.0)), 6).alias("rate"),
        F.greatest(F.col("total") - done, F.lit(0)).alias("remaining"),
    )


def quality_profile(issues: DataFrame, project_col: str = "project_identifier",
                    marker: str = r"^Subject: ", noise: str = C.PII_RULES[0][1]) -> DataFrame:
    """Per project: share with journals, mean journals, template-marker share,
    noise-URL share (these decide which projects get the journals-only rule)."""
    n_j = journal_count(issues)
    text = F.coalesce(F.col("description"), F.lit(""))
    return issues.groupBy(project_col).agg(
        F.count(F.lit(1)).alias("issues"),
        F.round(F.avg((n_j > 0).cast("double")), 6).alias("share_with_journals"),
        F.round(F.avg(n_j.cast("double")), 6).alias("mean_journals"),
        F.round(F.avg(text.rlike(java_pattern(marker)).cast("double")), 6).alias("share_marker"),
        F.round(F.avg(text.rlike(java_pattern(noise)).cast("double")), 6).alias("share_noise_url"),
    )


def project_counts(issues: DataFrame, project_col: str = "project_identifier") -> DataFrame:
    """Issues per project."""
    return issues.groupBy(project_col).agg(F.count(F.lit(1)).alias("n_issues"))


def sync_state_from_versions(versions: DataFrame, project_col: str = "project_identifier",
                             ts_col: str = "updated_ts") -> DataFrame:
    """Sync state implied by a version log: latest update per project."""
    return (versions.groupBy(F.col(project_col).alias("project_id"))
            .agg(F.date_format(F.max(ts_col), ISO_UTC).alias("last_synced_at"),
                 F.lit(1).cast("int").alias("sync_count")))
