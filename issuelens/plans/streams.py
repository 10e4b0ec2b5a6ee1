"""Registered streaming queries (X1-X6) over the event log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.session import scratch_path
from issuelens.sources.tables import read_table
from issuelens.streaming import sync as S


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex}")


def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Events streamed as issue updates, upserted per micro-batch.

    The result is the latest version of every issue (``user_id``), the same
    as the batch dedup of the whole log.
    """
    schema = read_table(spark, sf, "events").schema
    root = _scratch(spark, "upsert")

    def to_versions(s: DataFrame) -> DataFrame:
        return s.select(F.col("user_id").alias("id"), "event_id", "event_type", "value", "ts",
                        F.struct("ts", "event_id").alias("order_key"))

    stream = S.file_stream(spark, sf, schema, "events.parquet")
    S.run_upsert_stream(stream, f"{root}/table", f"{root}/_ckpt",
                        key="id", order_col="order_key", transform=to_versions)
    out = S.upsert_table(spark, f"{root}/table", to_versions(stream).schema, "id").read()
    return out.select("id", "event_id", "event_type", F.round("value", 6).alias("value"))


def stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """The newer half of the events arrives first, then all of them again; the result stays the latest versions."""
    events = read_table(spark, sf, "events")
    root = _scratch(spark, "late")
    half = events.agg(F.expr("percentile_approx(unix_micros(cast(ts as timestamp)), 0.5)")).first()[0] or 0
    at = F.expr("unix_micros(cast(ts as timestamp))")

    def arrive(part: int, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{root}/in/part={part}")
        stream = S.file_stream(spark, f"{root}/in/*", events.schema).withColumn("order_key", F.struct("ts", "event_id"))
        S.run_upsert_stream(stream, f"{root}/table", f"{root}/_ckpt", key="user_id", order_col="order_key")
        return S.upsert_table(spark, f"{root}/table", stream.schema, "user_id").read()

    arrive(1, events.where(at >= half))
    arrive(2, events.where(at < half))
    return arrive(3, events).select(
        F.col("user_id").alias("id"), "event_id", "event_type", F.round("value", 6).alias("value"))


def latest_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The running latest version of each key."""
    schema = read_table(spark, sf, "events").schema
    root = _scratch(spark, "latest")
    stream = S.file_stream(spark, sf, schema, "events.parquet").withColumn("order_key", F.struct("ts", "event_id"))
    S.run_update_to_versions(S.latest_versions(stream, "user_id", "order_key"), f"{root}/table", f"{root}/_ckpt",
                             ["user_id"])
    return S.read_latest(spark, f"{root}/table").select(
        F.col("user_id").alias("id"), "event_id", "event_type", F.round("value", 6).alias("value"))


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Daily tumbling windows per event type, watermarked."""
    schema = read_table(spark, sf, "events").schema
    root = _scratch(spark, "windows")
    stream = S.file_stream(spark, sf, schema, "events.parquet")
    # watermarks need TIMESTAMP; the log's NTZ values are read as UTC
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    agg = S.windowed_counts(stream, "ts", "event_type", "value", "1 day")
    S.run_update_to_versions(agg, f"{root}/table", f"{root}/_ckpt", ["w", "event_type"])
    out = S.read_latest(spark, f"{root}/table")
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      "event_type", F.col("n").cast("bigint").alias("n"),
                      F.round("total", 6).alias("total"))


def stream_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The batch column functions (anonymise, scrub, chunk) on a stream of
    documents; micro-batches are upserted into a bucketed chunk table."""
    from issuelens import config as C
    from issuelens.operators import documents as D
    from issuelens.operators.anonymize import anonymize_issues
    from issuelens.sources.adapters import document_issues

    schema = read_table(spark, sf, "documents").schema
    root = _scratch(spark, "chunks")
    stream = S.file_stream(spark, sf, schema, "documents.parquet")
    chunks = D.prepare_chunks(anonymize_issues(document_issues(stream)), C.JOURNALS_PER_CHUNK, None)
    chunks = chunks.withColumn("_order", F.col("chunk_index"))
    S.run_upsert_stream(chunks, f"{root}/table", f"{root}/_ckpt", key="id", order_col="_order")
    return S.upsert_table(spark, f"{root}/table", chunks.schema, "id").read().select("id", "text", "issue_id")


def stream_chunk_state(spark: SparkSession, sf: str) -> DataFrame:
    """X2 + D6: turns arrive as issue updates in three parts, each with turns between those of the parts before;
    the state of each issue rewrites the chunks that they change."""
    from issuelens import config as C
    from issuelens.functions.text import first_line, id_text, non_empty
    from issuelens.streaming import chunk_state as K

    turns = read_table(spark, sf, "conversations")
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("t0"), F.min_by("text", "turn").alias("text0"))
    name = F.when(non_empty("role"), F.col("role")).otherwise(F.lit(C.UNKNOWN_USER))
    opens = F.col("turn") == F.col("t0")
    updates = turns.join(first, "conv_id").select(
        id_text("conv_id").alias("issue_id"), opens.alias("is_issue"), first_line("text0").alias("subject"),
        F.when(opens, F.col("text")).alias("body"), F.when(~opens, K.comment_line(name, F.col("text"))).alias("line"),
        F.col("turn").cast("long").alias("pos"))
    root = _scratch(spark, "chunk-state")
    for part in (2, 0, 1):
        updates.where(F.col("pos") % 3 == part).write.parquet(f"{root}/in/part={part}")
        stream = S.file_stream(spark, f"{root}/in/*", updates.schema)
        table = K.run_chunk_stream(stream, f"{root}/table", f"{root}/_ckpt", spark.sparkContext.defaultParallelism)
    return table.select("id", "text", "issue_id", F.col("chunk_index").cast("long").alias("chunk_index"), "is_description")


def _two_parts(spark: SparkSession, sf: str, name: str) -> tuple[str, DataFrame, list[DataFrame]]:
    """Events in two deliveries: the later half of them (by time), then the earlier half and what the first brought."""
    events = read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    half = events.agg(F.expr("percentile_approx(unix_micros(ts), 0.5)")).first()[0] or 0
    first = events.where(F.expr("unix_micros(ts)") >= half)
    return _scratch(spark, name), events, [first, events]


def stream_replays(spark: SparkSession, sf: str) -> DataFrame:
    """The events delivered twice, in two files of one update each; a replayed update adds no row."""
    events = read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    root = _scratch(spark, "replays")
    for part in (1, 2):
        events.write.parquet(f"{root}/in/part={part}")
    stream = S.drop_replays(S.file_stream(spark, f"{root}/in/*", events.schema), ["event_id"], "ts")
    out = S.run_append(stream, f"{root}/out", f"{root}/_ckpt")
    return out.select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))


def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of a day that begin every 12 hours, per event type, watermarked, in update mode."""
    schema = read_table(spark, sf, "events").schema
    root = _scratch(spark, "sliding")
    stream = S.file_stream(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    agg = S.windowed_counts(stream, "ts", "event_type", "value", "1 day", "12 hours")
    S.run_update_to_versions(agg, f"{root}/table", f"{root}/_ckpt", ["w", "event_type"])
    return S.read_latest(spark, f"{root}/table").select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type",
        F.col("n").cast("bigint").alias("n"), F.round("total", 6).alias("total"))


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user (a day's silence closes one) that the watermark has passed, each told once."""
    events = read_table(spark, sf, "events")
    root = _scratch(spark, "sessions")
    stream = S.file_stream(spark, sf, events.schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.run_append(S.closed_sessions(stream, "ts", "user_id", "1 day"), f"{root}/out", f"{root}/_ckpt")
    at = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return out.select("user_id", F.date_format("start", at).alias("session_start"), F.date_format("end", at).alias("session_end"),
                      F.col("n").cast("bigint").alias("n"))


def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The events that come behind the watermark when the newer half is delivered first and all of them later."""
    root, events, parts = _two_parts(spark, sf, "late-rows")
    for n, rows in enumerate(parts):
        rows.write.parquet(f"{root}/in/part={n}")
        S.run_late_rows(S.file_stream(spark, f"{root}/in/*", events.schema), "ts", "1 hour", f"{root}/late", f"{root}/_ckpt")
    return S.read_late_rows(spark, f"{root}/late", events.schema).select("event_id", "user_id")
