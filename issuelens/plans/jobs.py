"""The batch job of one deployment: issues in, searchable chunks out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.config import EngineConfig
from issuelens.functions.text import id_text
from issuelens.operators import merge as M
from issuelens.operators import runlog as L
from issuelens.operators.anonymize import anonymize_issues, user_mapping, user_refs
from issuelens.operators.collection import Collection
from issuelens.operators.documents import embed_windows, prepare_chunks
from issuelens.operators.embed import HashEmbedder, embed
from issuelens.operators.tables import CODEC, BucketTable, without
from issuelens.plans import inputs as I
from issuelens.schemas import ISSUE, ISSUE_FIELDS, JOURNAL, USER
from issuelens.session import scratch_path
from issuelens.sources import issues as SI
from issuelens.sources import state as SS

ORDER = "_order"


def _ordered(issues: DataFrame) -> DataFrame:
    """``_order``: by time of update, then by position (``seq``, or the order of arrival)."""
    at = F.col("seq").cast("string") if "seq" in issues.columns else F.lit("")
    place: Column = F.struct(F.try_to_timestamp("updated_on").alias("at"), F.length(at).alias("digits"), at.alias("seq"))
    return issues.withColumn(ORDER, place)


def fetch(spark: SparkSession, config: EngineConfig, source: DataFrame, since: str | None = None,
          full: bool = False, details: DataFrame | None = None) -> DataFrame:
    """The issues that one run takes from ``source``, each once, in its latest version.

    A full load takes all of the configured projects.  Issues without
    journals are replaced by their full record, where ``details`` has one, and
    in the journals-only projects those still without journals are left out.
    An incremental run takes what was updated at or after ``since``, by default
    the earliest of the projects' last runs, and leaves nothing out.
    """
    rows = _ordered(M.project_union(source, config.project_ids).drop("project_rank"))
    if not full:
        if since is None:
            state = SS.load_sync_state(spark, config.state_dir, config.project_ids)
            since = M.resolve_since_value(state, config.project_ids)
        rows = M.changed_since(rows, since, f"{ORDER}.at")
    rows = M.latest(rows, "id", F.col(ORDER)).select(*ISSUE_FIELDS)
    if not full:
        return rows
    if details is not None:
        lacking = M.missing_journals(rows).select("id")
        rows = M.enrich_overlay(rows, details.select(*ISSUE_FIELDS).join(lacking, "id", "left_semi"))
    return M.journals_only(rows, config.journals_only_projects)


def issue_store(spark: SparkSession, config: EngineConfig, buckets: int = 8) -> BucketTable:
    """The master set: issues by id, a directory for each project."""
    return BucketTable(spark, f"{config.raw_dir}/issues", ISSUE, "id", buckets, ("project_identifier",))


def ingest(spark: SparkSession, config: EngineConfig, incoming: DataFrame, embedder, started_at: str) -> Collection:
    """Stores fetched issues (each id once) and brings the collection up to date.

    The incoming issues replace those of equal id in the issue store, the
    user mapping is published apart from the data, and the chunks of these
    issues are scrubbed, cut, embedded and upserted; chunks that an issue no
    longer has go.  In both tables only the buckets of these issues are
    rewritten.  The sync state of the projects is advanced, and the run's
    numbers, counted as the issues and windows were written, go to the run log.
    """
    run = uuid.uuid4().hex
    path = scratch_path(spark, f"incoming/{run}")
    observed, issues_seen = L.observe_issues(incoming.select(*ISSUE_FIELDS), f"issues-{run}")
    observed.write.option("compression", CODEC).parquet(path)
    incoming = spark.read.schema(ISSUE).parquet(path)
    store = issue_store(spark, config)
    store.upsert(incoming, lambda here, new: without(here, new, "id").select(*ISSUE_FIELDS).union(new), incoming)

    master = store.read().withColumn("seq", F.col("id"))
    SI.write_user_mapping(user_mapping(master), f"{config.base_path.rstrip('/')}/restricted/{uuid.uuid4().hex}")
    chunks = prepare_chunks(anonymize_issues(incoming), config.journals_per_chunk, config.max_text_len)
    collection = Collection(spark, config.collection_dir, "chunks").get_or_create()
    windows, windows_seen = L.observe_windows(
        embed(embed_windows(chunks, config.embed_max_chars), embedder, "window", None), f"windows-{run}")
    ids = incoming.select(id_text("id").alias("issue_id"))
    once = ids.groupBy("issue_id").count().where("count > 1").isEmpty()
    collection.upsert(windows, prune_stale=True, issues=ids if once else None)

    state = SS.load_sync_state(spark, config.state_dir, config.project_ids)
    synced = incoming.select(F.col("project_identifier").alias("project_id"))
    SS.save_sync_state(M.advance_sync_state(state, synced, started_at), config.state_dir)

    numbers = issues_seen.get | windows_seen.get | {"started_at": started_at}
    record = L.user_sketch(user_refs(incoming.withColumn("seq", F.lit(0)))).select(
        *(F.lit(v).alias(k) for k, v in sorted(numbers.items())), "users")
    record.write.mode("append").parquet(run_log(config))
    return collection


def run_log(config: EngineConfig) -> str:
    """Where each run leaves its numbers and its sketch of users."""
    return f"{config.base_path.rstrip('/')}/runs"


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as a first listing (drafts of the even ones), full records of some of them, and a second listing.

    The second has of each document several versions, the newest not last,
    and every third document as it was before the first run.
    """
    docs = I.doc_issues(spark, sf)

    def version(rows: DataFrame, updated: str, word: str) -> DataFrame:
        return rows.withColumn("description", F.concat(F.lit(word), "description")).withColumn("updated_on", F.lit(updated))

    early = version(docs.where("id % 2 = 0"), "2023-12-01T00:00:00Z", "draft ")
    note = F.lit("see https://openqa.suse.de/tests/7 on build.lab or ask qa@example.com")
    reviewer = F.struct(F.lit(7).cast("long").alias("id"), F.lit("Reviewer").alias("name"))
    journal = F.struct(F.lit(1).cast("long").alias("id"), reviewer.alias("user"), note.alias("notes"),
                       F.lit(None).cast("string").alias("created_on"))
    details = (version(docs.where("id % 12 = 0"), "2023-12-02T00:00:00Z", "whole ")
               .withColumn("journals", F.array(journal).cast(f"array<{JOURNAL.simpleString()}>"))
               .withColumn("watchers", F.array(reviewer).cast(f"array<{USER.simpleString()}>")))
    later = (version(docs.where("id % 3 <> 0"), "2024-01-15T00:00:00Z", "")
             .union(version(docs.where("id % 3 <> 0"), "2024-01-10T00:00:00Z", "second draft "))
             .union(version(docs.where("id % 3 = 0"), "2023-12-20T00:00:00Z", "unseen ")))
    return early, details, later


def _two_runs(spark: SparkSession, sf: str) -> tuple[EngineConfig, Collection]:
    early, details, later = _versions(spark, sf)
    projects = tuple(r[0] for r in early.union(later).select("project_identifier").where(
        F.col("project_identifier").isNotNull()).distinct().collect())
    config = EngineConfig(base_path=scratch_path(spark, f"ingest/{uuid.uuid4().hex}"), project_ids=projects,
                          journals_only_projects=I.JOURNALS_ONLY)
    embedder = HashEmbedder(I.EMBED_DIM)
    ingest(spark, config, fetch(spark, config, early, full=True, details=details), embedder, "2024-01-01T00:00:00Z")
    return config, ingest(spark, config, fetch(spark, config, later), embedder, "2024-02-01T00:00:00Z")


def ingest_job(spark: SparkSession, sf: str) -> DataFrame:
    """A full load of document issues with enrichment, then an incremental run since the first one's start."""
    _, collection = _two_runs(spark, sf)
    return collection.read().select("id", "chunk_id", "part", "issue_id", "text", "project")


def run_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """A14 + D8: the numbers that the two runs of ``ingest_job`` left in the run log."""
    config, _ = _two_runs(spark, sf)
    return spark.read.parquet(run_log(config)).select("started_at", "issues", "with_journals", "chunked_issues", "chunks",
                                                      "windows")
