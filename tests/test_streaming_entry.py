import uuid

from pyspark.sql import functions as F

import __spark_entry__ as E
from issuelens.operators import merge as M
from issuelens.session import scratch_path
from issuelens.streaming import sync as S

SF = "/root/testdata/sf0.001"


def test_stream_upsert_reads_only_new_files(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    root = scratch_path(spark, f"test-stream/{uuid.uuid4().hex}")
    src = f"{root}/in"
    cut = "2024-01-15"
    ev.where(F.col("ts") < F.lit(cut)).write.parquet(f"{src}/part=1")
    schema = ev.schema

    def run():
        stream = S.file_stream(spark, f"{src}/*", schema)
        S.run_upsert_stream(stream.withColumn("order_key", F.struct("ts", "event_id")), f"{root}/table",
                            f"{root}/_ckpt", key="user_id", order_col="order_key")

        return S.upsert_table(spark, f"{root}/table", stream.withColumn("order_key", F.struct("ts", "event_id")).schema,
                              "user_id").read()

    files = set(run().inputFiles())
    assert files and set(run().inputFiles()) == files  # nothing new: nothing written
    ev.where(F.col("ts") >= F.lit(cut)).write.parquet(f"{src}/part=2")
    table = run()
    assert set(table.inputFiles()) != files
    got = sorted((r.user_id, r.event_id) for r in table.collect())
    batch = M.dedup_last(ev.withColumn("seq", F.struct("ts", "event_id")), "user_id", "seq")
    assert got == sorted((r.user_id, r.event_id) for r in batch.collect())


def test_windowed_and_session_counts_match_batch(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    root = scratch_path(spark, f"test-win/{uuid.uuid4().hex}")
    stream = S.file_stream(spark, SF, spark.read.parquet(f"{SF}/events.parquet").schema, "events.parquet")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    S.run_complete_to_versions(S.windowed_counts(stream, "ts", "event_type", "value", "1 day", "12 hours"),
                               f"{root}/t", f"{root}/_c")
    got = sorted((str(r.w.start), r.event_type, r.n) for r in S.read_latest(spark, f"{root}/t").collect())
    want = ev.groupBy(F.window("ts", "1 day", "12 hours").alias("w"), "event_type").count()
    assert got == sorted((str(r.w.start), r.event_type, r["count"]) for r in want.collect())


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.columns == ["question_id", "prompt"] and df.count() > 0
    qs, oracle = E.queries(), E.oracle_sql()
    assert set(oracle) <= set(qs)
    own = {q for q in set(qs) - set(oracle) if q != "pipeline" and not q.startswith("op")}
    assert not own


def test_latest_versions_update_mode(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    root = scratch_path(spark, f"test-latest/{uuid.uuid4().hex}")
    stream = S.file_stream(spark, SF, ev.schema, "events.parquet")
    agg = S.latest_versions(stream.select("user_id", "event_id", "value",
                                          F.struct("ts", "event_id").alias("k")), "user_id", "k")
    S.run_complete_to_versions(agg, f"{root}/t", f"{root}/_c")
    got = sorted((r.user_id, r.event_id) for r in S.read_latest(spark, f"{root}/t").collect())
    batch = M.dedup_last(ev.withColumn("seq", F.struct("ts", "event_id")), "user_id", "seq")
    assert got == sorted((r.user_id, r.event_id) for r in batch.collect())


def test_ingest_stream_into_collection(spark, make_issues):
    from issuelens.operators import documents as D
    from issuelens.operators.anonymize import anonymize_issues
    from issuelens.operators.collection import Collection
    from issuelens.operators.embed import HashEmbedder
    from issuelens.schemas import ISSUE
    from tests.conftest import base_issue, journal

    root = scratch_path(spark, f"test-ingest/{uuid.uuid4().hex}")
    make_issues([base_issue(id=1, journals=[journal(1, "B", 2, "mail a@b.com")])]).drop("seq") \
        .write.json(f"{root}/in/b=1")
    stream = spark.readStream.schema(ISSUE).json(f"{root}/in/*")
    chunks = D.prepare_chunks(anonymize_issues(stream), 5, 8192)
    coll = Collection(spark, root, "coll")
    S.run_ingest_stream(D.embed_windows(chunks), coll, HashEmbedder(8), checkpoint=f"{root}/_c")
    got = sorted((r.id, r.text) for r in coll.read().collect())
    assert got == [("issue_1", "Subject: Cache fills the disk\nDescription: It grows every night"),
                   ("issue_1_chunk_1", "Subject: Cache fills the disk\nComments:\n- User_00002: mail [REDACTED-EMAIL]")]


def test_session_counts_match_batch(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    root = scratch_path(spark, f"test-sess/{uuid.uuid4().hex}")
    stream = S.file_stream(spark, SF, spark.read.parquet(f"{SF}/events.parquet").schema, "events.parquet")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    S.run_complete_to_versions(S.session_counts(stream, "ts", "event_type", "6 hours"), f"{root}/t", f"{root}/_c")
    got = sorted((str(r.s.start), r.event_type, r.n) for r in S.read_latest(spark, f"{root}/t").collect())
    want = ev.groupBy(F.session_window("ts", "6 hours").alias("s"), "event_type").count()
    assert got == sorted((str(r.s.start), r.event_type, r["count"]) for r in want.collect())


def test_replayed_files_are_dropped(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    root = scratch_path(spark, f"test-replay/{uuid.uuid4().hex}")
    ev.write.parquet(f"{root}/in/a=1")
    ev.write.parquet(f"{root}/in/a=2")  # the same updates delivered twice
    stream = S.file_stream(spark, f"{root}/in/*", ev.schema)
    out = S.drop_replays(stream, ["event_id"], "ts")
    q = (out.writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/_c").trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.read.parquet(f"{root}/out").count() == ev.count()


def test_late_older_rows_do_not_replace_newer_ones(spark):
    root = scratch_path(spark, f"test-late/{uuid.uuid4().hex}")
    schema = "k long, version long, body string"

    def arrive(part, rows):
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/in/part={part}")
        stream = S.file_stream(spark, f"{root}/in/*", spark.createDataFrame([], schema).schema)
        S.run_upsert_stream(stream, f"{root}/table", f"{root}/_ckpt", key="k", order_col="version")
        return {r.k: (r.version, r.body) for r in S.upsert_table(spark, f"{root}/table", stream.schema, "k").read().collect()}

    assert arrive(1, [(1, 10, "new"), (2, 1, "a"), (1, 9, "x")]) == {1: (10, "new"), 2: (1, "a")}
    assert arrive(2, [(1, 5, "old"), (2, 2, "b"), (3, 1, "c")]) == {1: (10, "new"), 2: (2, "b"), 3: (1, "c")}


def test_updated_windows_replace_their_rows(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    root = scratch_path(spark, f"test-update/{uuid.uuid4().hex}")
    parts = [ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1")]
    for n, part in enumerate(parts):
        part.write.parquet(f"{root}/in/part={n}")
        stream = S.file_stream(spark, f"{root}/in/*", ev.schema).withColumn("ts", F.col("ts").cast("timestamp"))
        agg = S.windowed_counts(stream, "ts", "event_type", "value", "1 day", watermark="400 days")
        S.run_update_to_versions(agg, f"{root}/t", f"{root}/_c", ["w", "event_type"])
    got = {(r.w.start, r.event_type): r.n for r in S.read_latest(spark, f"{root}/t").collect()}
    want = ev.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").alias("w"), "event_type").count()
    assert got == {(r.w.start, r.event_type): r["count"] for r in want.collect()}


def test_rows_behind_the_watermark_are_put_aside(spark):
    root = scratch_path(spark, f"test-behind/{uuid.uuid4().hex}")
    schema = "k long, ts timestamp"

    def arrive(n, rows):
        (spark.createDataFrame(rows, "k long, t string").select("k", F.to_timestamp("t").alias("ts"))
         .write.parquet(f"{root}/in/part={n}"))
        stream = S.file_stream(spark, f"{root}/in/*", spark.createDataFrame([], schema).schema)
        S.run_late_rows(stream, "ts", "1 hour", f"{root}/late", f"{root}/_c")
        return sorted(r.k for r in S.read_late_rows(spark, f"{root}/late", stream.schema).collect())

    day = "2024-01-01 "
    assert arrive(1, [(1, day + "10:00:00"), (2, day + "01:00:00")]) == []  # the first batch has no watermark yet
    assert arrive(2, [(3, day + "08:59:59"), (4, day + "09:00:00"), (5, day + "12:00:00")]) == [3]
    assert arrive(3, [(6, day + "10:30:00")]) == [3, 6]
    assert arrive(4, [(7, day + "11:00:00"), (8, None)]) == [3, 6]


def test_a_closed_session_is_told_once(spark):
    root = scratch_path(spark, f"test-closed/{uuid.uuid4().hex}")
    schema = "u long, ts timestamp"

    def arrive(n, rows):
        (spark.createDataFrame([(u, f"2024-01-01 {t}") for u, t in rows], "u long, t string")
         .select("u", F.to_timestamp("t").alias("ts")).write.parquet(f"{root}/in/part={n}"))
        stream = S.file_stream(spark, f"{root}/in/*", spark.createDataFrame([], schema).schema)
        out = S.run_append(S.closed_sessions(stream, "ts", "u", "30 minutes", "10 minutes"), f"{root}/out", f"{root}/_c")
        return sorted((r.u, str(r.start)[11:], str(r.end)[11:], r.n) for r in out.collect())

    assert arrive(1, [(1, "08:00:00"), (1, "08:20:00"), (2, "08:55:00")]) == []
    assert arrive(2, [(1, "09:00:00"), (1, "08:40:00")]) == []  # 8:40 joins 8:00 to 8:20, and 9:00
    assert arrive(3, [(3, "12:00:00")]) == [(1, "08:00:00", "09:30:00", 4), (2, "08:55:00", "09:25:00", 1)]
    assert arrive(4, [(2, "08:56:00")]) == [(1, "08:00:00", "09:30:00", 4), (2, "08:55:00", "09:25:00", 1)]
