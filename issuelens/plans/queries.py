"""Registered queries: one DataFrame plan per operator group of the survey.

Each function takes ``(spark, sf_dir)`` and reads whole tables.  Every
computed column is aliased to the name used by the oracle SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.functions.text import cap
from issuelens.functions.vector import hash_embed
from issuelens.operators import answer as R
from issuelens.operators import approx as X
from issuelens.operators import documents as D
from issuelens.operators import evaluate as Q
from issuelens.operators import filters as FL
from issuelens.operators import merge as M
from issuelens.operators import runlog as T
from issuelens.operators import turns as TU
from issuelens.operators.anonymize import (anonymize_issues, mapping_from_refs, pii_audit, run_summary,
                                           user_mapping as _user_mapping, user_refs)
from issuelens.sources import adapters as A
from issuelens.operators.search import SearchSpec, fetch_window, search, search_bounded
from issuelens.functions.pii import scrub_pii as _scrub
from issuelens.plans import inputs as I
from issuelens.session import scratch_path
from issuelens.sources import questions as SQ
from issuelens.sources import state as SS
from issuelens.sources.tables import read_table, spread

# ---------------------------------------------------------------------------
# D: documents and chunks
# ---------------------------------------------------------------------------


def issue_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """D1 on conversation issues (from partial aggregates, no journal arrays)."""
    return I.conv_summary(spark, sf).select(*D.metadata_columns(journal_count=F.col("n_journals")))


def journal_text(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered comment lines per issue (bounded assembly above the gather limit)."""
    return TU.conversation_journal_text(read_table(spark, sf, "conversations"))


def prepare_single(spark: SparkSession, sf: str) -> DataFrame:
    """D3 + D4: one document per conversation issue (ingest cap 8192), from
    the turn rows with bounded work per conversation."""
    return TU.conversation_documents(read_table(spark, sf, "conversations"), C.MAX_TEXT_LEN)


def prepare_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """D5-D7 with the function defaults (5 journals, 4000 characters), from turn rows."""
    ch = TU.conversation_chunks(read_table(spark, sf, "conversations"), C.JOURNALS_PER_CHUNK,
                                C.CHUNK_MAX_TEXT_LEN, anonymize=False)
    return ch.select("id", "text", "issue_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
                     "is_description", "num_journals")


def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    """D8 over conversation and document issues at ingest settings."""
    conv = TU.conversation_chunks(read_table(spark, sf, "conversations"), C.JOURNALS_PER_CHUNK,
                                  C.MAX_TEXT_LEN, anonymize=False).select("issue_id")
    docs = D.prepare_chunks(I.doc_issues(spark, sf), C.JOURNALS_PER_CHUNK, C.MAX_TEXT_LEN).select("issue_id")
    return D.expansion_counts(conv.unionByName(docs))


def truncate_docs(spark: SparkSession, sf: str) -> DataFrame:
    """D4 on every document at 8192."""
    d = I.documents(spark, sf)
    t = D.truncate(F.col("text"), C.MAX_TEXT_LEN)
    return d.select("doc_id", t.alias("text"), F.length(t).cast("bigint").alias("n_chars_out"),
                    (F.length("text") > C.MAX_TEXT_LEN).alias("truncated"))


def embed_input(spark: SparkSession, sf: str) -> DataFrame:
    """The text the embedder sees (first 1500 characters)."""
    d = I.documents(spark, sf)
    t = cap(F.col("text"), C.EMBED_MAX_CHARS)
    return d.select("doc_id", t.alias("embed_text"), F.length(t).cast("bigint").alias("embed_len"))


# ---------------------------------------------------------------------------
# A: anonymisation
# ---------------------------------------------------------------------------


def scrub_pii(spark: SparkSession, sf: str) -> DataFrame:
    """A7-A11 on every document text."""
    d = I.documents(spark, sf)
    s = _scrub("text")
    return d.select("doc_id", s.alias("text"), (s != F.col("text")).alias("changed"))


def scrub_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A7-A11 with a parameterised rule list on every page (url + html)."""
    pages = spread(read_table(spark, sf, "pages"))
    text = F.concat_ws("\n", F.col("url"), F.col("html"))
    s = _scrub(text, I.PAGE_RULES)
    return pages.select("page_id", s.alias("text"), (s != text).alias("changed"))


def pii_audit_q(spark: SparkSession, sf: str) -> DataFrame:
    """Redacted matches per document and kind, counted."""
    a = pii_audit(I.documents(spark, sf), "doc_id", "text")
    return a.groupBy("doc_id", "kind", "match").agg(F.count(F.lit(1)).alias("n"))


def user_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """A1-A2: first-seen name per user id over order issues, then conversations.

    Conversation references come straight from the turn rows (author = first
    turn, journals = later turns, so turn order is the reference order); no
    conversation is gathered into one row.
    """
    cols = ["author", "assigned_to", "journals", "watchers"]
    o = I.order_issues(spark, sf).select(*cols, F.struct(F.lit(0).alias("src"), F.col("seq").alias("pos")).alias("seq"))
    turns = read_table(spark, sf, "conversations")
    uid = A._lookup(F.col("role"), A.ROLE_USER_IDS).cast("bigint")
    conv_refs = turns.select(F.struct(F.lit(1).alias("src"), F.col("conv_id").alias("pos")).alias("seq"),
                             F.lit(0).alias("role_rank"), F.col("turn").cast("int").alias("idx"),
                             F.struct(uid.alias("id"), F.col("role").alias("name")).alias("user")) \
        .where(uid.isNotNull())
    return mapping_from_refs(user_refs(o).unionByName(conv_refs))


def anonymize_users(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation issues after anonymisation, flattened."""
    return TU.conversation_user_lists(read_table(spark, sf, "conversations"))


def anonymize_watchers(spark: SparkSession, sf: str) -> DataFrame:
    """A4 + A6 on the order issues."""
    out = anonymize_issues(I.order_issues(spark, sf))
    return out.select(F.col("id").alias("issue_id"), F.col("author.name").alias("author"),
                      F.array_join(F.transform("watchers", lambda w: w.getField("name")), ",").alias("watchers"))


def anonymize_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A14 on the order issues."""
    issues = I.order_issues(spark, sf)
    return run_summary(issues, _user_mapping(issues))


# ---------------------------------------------------------------------------
# M: incremental load and merge (event log as the update stream)
# ---------------------------------------------------------------------------

_VCOLS = ["id", "event_id", "updated_on", "project_identifier", "value"]


def _existing(spark, sf):
    v = I.versions(spark, sf)
    old = v.where(F.col("updated_ts") < F.to_timestamp(F.lit(I.CUTOFF)))
    return M.dedup_last(old, "id", "seq").drop("first_seq")


def _incoming(spark, sf):
    return M.changed_since(I.versions(spark, sf), I.CUTOFF)


def changed_since(spark: SparkSession, sf: str) -> DataFrame:
    """M1."""
    return _incoming(spark, sf).select(*_VCOLS)


def resolve_since(spark: SparkSession, sf: str) -> DataFrame:
    """M2: earliest last sync over the event projects."""
    state = M.sync_state_from_versions(I.versions(spark, sf))
    return M.resolve_since(state, I.EVENT_PROJECTS)


def merge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """M3: snapshot before the cutoff upserted with every later version."""
    return M.merge_upsert(_existing(spark, sf), _incoming(spark, sf), "id", "seq").select(*_VCOLS)


def merge_counts(spark: SparkSession, sf: str) -> DataFrame:
    """M3 counts (H1 semantics): the first hours of the log, and all that came after them."""
    v, at = I.versions(spark, sf), F.to_timestamp(F.lit(I.EARLY))
    return M.merge_counts(v.where(F.col("updated_ts") < at), v.where(F.col("updated_ts") >= at), "id")


def dedup_last(spark: SparkSession, sf: str) -> DataFrame:
    """M5 over the whole log ordered by event id."""
    v = I.versions(spark, sf).withColumn("seq", F.col("event_id"))
    return M.dedup_last(v, "id", "seq").select(*_VCOLS, F.col("first_seq").alias("first_event_id"))


def project_union(spark: SparkSession, sf: str) -> DataFrame:
    """M4: listed projects concatenated in list order."""
    v = I.versions(spark, sf)
    return M.project_union(v, I.UNION_PROJECTS).select(*_VCOLS, F.col("project_rank").cast("bigint").alias("project_rank"))


def journals_only(spark: SparkSession, sf: str) -> DataFrame:
    """M6 on conversation + document issues."""
    return M.journals_only(I.all_issues(spark, sf), I.JOURNALS_ONLY).select(
        "id", "project_identifier", F.col("n_journals").cast("bigint").alias("n_journals"))


def missing_journals(spark: SparkSession, sf: str) -> DataFrame:
    """M7."""
    return M.missing_journals(I.all_issues(spark, sf)).select("id", "project_identifier")


def enrich_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """M8: document issues overlaid by conversation issues fetched in full."""
    cols = ["id", "subject", "description", "project_identifier", "n_journals"]
    bulk = I.doc_issues(spark, sf).withColumn("n_journals", F.lit(0).cast("bigint")).select(*cols)
    full = I.conv_summary(spark, sf).select(*cols)
    o = M.enrich_overlay(bulk, full, "id")
    return o.select("id", "subject", "project_identifier", F.col("n_journals").cast("bigint").alias("n_journals"))


def journal_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """M9 per project."""
    return M.journal_coverage(I.all_issues(spark, sf), "project_identifier")


def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Issues still to load = all issue ids minus those done in the first hours."""
    v = I.versions(spark, sf)
    done = v.where(F.col("updated_ts") < F.to_timestamp(F.lit(I.EARLY)))
    return M.resume_pending(v.select("id").distinct(), done, "id")


def load_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Done >= total per project."""
    v = I.versions(spark, sf).withColumnRenamed("project_identifier", "project_id")
    totals = v.groupBy("project_id").agg(F.countDistinct("id").alias("total"))
    done = v.where(F.col("updated_ts") < F.to_timestamp(F.lit(I.CUTOFF)))
    return M.completeness(done, totals, "project_id")


def load_progress(spark: SparkSession, sf: str) -> DataFrame:
    """M12 per project: the log before the cutoff against the full totals."""
    v = I.versions(spark, sf).withColumnRenamed("project_identifier", "project_id")
    totals = v.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"))
    log = v.where(F.col("updated_ts") < F.to_timestamp(F.lit(I.CUTOFF)))
    return M.load_progress(log, totals, "project_id", "updated_ts")


def quality_profile(spark: SparkSession, sf: str) -> DataFrame:
    """M13 per project."""
    return M.quality_profile(I.all_issues(spark, sf), marker=I.MARKER, noise=I.NOISE)


def project_counts(spark: SparkSession, sf: str) -> DataFrame:
    """M14."""
    return M.project_counts(I.all_issues(spark, sf))


def sync_state(spark: SparkSession, sf: str) -> DataFrame:
    """State as of the cutoff advanced by the projects synced afterwards."""
    v = I.versions(spark, sf)
    before = M.sync_state_from_versions(v.where(F.col("updated_ts") < F.to_timestamp(F.lit(I.CUTOFF))))
    synced = _incoming(spark, sf).select(F.col("project_identifier").alias("project_id"))
    st = M.advance_sync_state(before, synced.where(F.col("project_id").isin(*I.UNION_PROJECTS)),
                              I.RUN_STARTED_AT)
    return st.withColumn("sync_count", F.col("sync_count").cast("bigint"))


def sync_state_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """S9 + M11: the state before and after a run saved one after the other, and the newest read back."""
    root = scratch_path(spark, f"state/{uuid.uuid4().hex}")
    v = I.versions(spark, sf)
    SS.save_sync_state(M.sync_state_from_versions(v.where(F.col("updated_ts") < F.to_timestamp(F.lit(I.CUTOFF)))), root)
    SS.save_sync_state(sync_state(spark, sf), root)
    projects = [r[0] for r in read_table(spark, sf, "events").select("event_type").distinct().collect()]
    return SS.load_sync_state(spark, root, [*projects, "never-synced"])


def numbered_answers(spark: SparkSession, sf: str) -> DataFrame:
    """S7 + R10: the answers of a batch as one numbered row set, header, answer and number of sources."""
    asked = I.benchmark_questions(spark, sf)
    answers = answer_batch(spark, sf).select("question_id", "answer", "n_hits")
    out = R.numbered_results(asked.join(answers, "question_id"))
    return out.select("question_id", "position", "header", "answer", "n_hits")


def numbered_results(spark: SparkSession, sf: str) -> DataFrame:
    """Headers of the benchmark questions."""
    return R.numbered_results(I.benchmark_questions(spark, sf)).select("question_id", "position", "header")


# ---------------------------------------------------------------------------
# V: vector search on the embeddings table
# ---------------------------------------------------------------------------

GATE = I.GATE


def _vsearch(spark, sf, spec: SearchSpec, with_filter: bool) -> DataFrame:
    qs = I.label_questions(spark, sf)
    if not with_filter:
        qs = qs.drop("label")
    hits = search(spark, I.embedding_collection(spark, sf), qs, spec)
    return hits.select("question_id", "id", "parent", "score", "rank", "filtered")


def knn_raw(spark: SparkSession, sf: str) -> DataFrame:
    """V5 + V12: top 5 chunks per question, no de-duplication."""
    return _vsearch(spark, sf, SearchSpec(top_k=5, deduplicate=False, filter_cols=("label",)), False)


def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """V6: filter (label = the question's label) before ranking."""
    return _vsearch(spark, sf, SearchSpec(top_k=5, deduplicate=False, filter_cols=("label",)), True)


def best_per_parent(spark: SparkSession, sf: str) -> DataFrame:
    """V7 + V8: best chunk per parent inside the 4k window (top 10 parents)."""
    return _vsearch(spark, sf, SearchSpec(top_k=10, deduplicate=True, filter_cols=("label",)), False)


def search_topk(spark: SparkSession, sf: str) -> DataFrame:
    """V9 + V11: full search, top 5 parents."""
    return _vsearch(spark, sf, SearchSpec(top_k=5, deduplicate=True, filter_cols=("label",)), True)


def score_gate(spark: SparkSession, sf: str) -> DataFrame:
    """All-or-nothing gate on the best score."""
    return _vsearch(spark, sf, SearchSpec(top_k=5, deduplicate=True, score_threshold=GATE,
                                          filter_cols=("label",), fallback=False), True)


def search_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Gated filtered search, unfiltered retry when it comes back empty."""
    return _vsearch(spark, sf, SearchSpec(top_k=5, deduplicate=True, score_threshold=GATE,
                                          filter_cols=("label",), fallback=True), True)


def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """V5 with the cosine metric."""
    return _vsearch(spark, sf, SearchSpec(top_k=5, deduplicate=True, metric="cosine",
                                          filter_cols=("label",)), False)


# ---------------------------------------------------------------------------
# R: filters, prompts, sources (text search over conversation chunks)
# ---------------------------------------------------------------------------

def _order_responses(spark, sf) -> DataFrame:
    """Model responses derived from orders, by their number: bare, fenced, with
    a sentence after the object, two objects, a bracket after the object, and
    that with more text; projects are named loosely."""
    o = I.order_issues(spark, sf)
    named = F.element_at(F.array(F.lit(" Kernel "), F.lit("perf"), F.lit("no such project")),
                         (F.col("id") % 3 + 1).cast("int"))
    js = F.to_json(F.struct(F.col("status.name").alias("status"), F.col("priority.name").alias("priority"),
                            named.alias("project")))
    form = F.col("id") % 6
    resp = (F.when(form == 0, js).when(form == 1, F.concat(F.lit("```json\n"), js, F.lit("\n```")))
            .when(form == 2, F.concat(js, F.lit("\nThis filters the issues.")))
            .when(form == 3, F.concat(js, F.lit(" "), js)).when(form == 4, F.concat(js, F.lit("]")))
            .otherwise(F.concat(js, F.lit("], that is all: [1"))))
    return o.select(F.col("id").alias("question_id"), resp.alias("response"))


def parse_filters(spark: SparkSession, sf: str) -> DataFrame:
    """R2-R4 on one response per order."""
    r = FL.extract_filters(_order_responses(spark, sf), "response")
    return r.select("question_id", "status", "priority", "project_id")


def extraction_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """Extraction prompt per benchmark question."""
    q = I.benchmark_questions(spark, sf)
    return q.select("question_id", FL.extraction_prompt("question").alias("prompt"))


def filter_predicate(spark: SparkSession, sf: str) -> DataFrame:
    """``status = New AND priority = High`` on the order issues' metadata."""
    meta = I.order_issues(spark, sf).select(*D.metadata_columns())
    return meta.where(FL.predicate({"status": "New", "priority": "High"})).select("issue_id", "status", "priority")


def _text_hits(spark, sf, spec=None):
    spec = spec or I.text_spec()
    coll = I.conversation_collection(spark, sf)
    qs = I.embedded_questions(I.benchmark_questions(spark, sf))
    hits, _ = search_bounded(spark, coll, qs, spec)
    return qs, coll, R.hit_details(hits, coll)


def prompt(spark: SparkSession, sf: str) -> DataFrame:
    """R7 + R8: prompts for every benchmark question over conversation chunks."""
    qs, _, det = _text_hits(spark, sf)
    return R.build_prompts(qs, det)


def source_cards(spark: SparkSession, sf: str) -> DataFrame:
    """R11 + R13."""
    _, _, det = _text_hits(spark, sf)
    return R.source_cards(det).drop("score_text")


def source_list(spark: SparkSession, sf: str) -> DataFrame:
    """R12."""
    _, _, det = _text_hits(spark, sf)
    return R.source_list(det).drop("score_text")


def search_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """V6 with table metadata: benchmark questions over document chunks,
    restricted to documents labelled ``quality = 1``."""
    coll = I.labelled_collection(spark, sf)
    qs = I.embedded_questions(I.benchmark_questions(spark, sf)).withColumn("quality", F.lit("1"))
    hits, _ = search_bounded(spark, coll, qs, I.text_spec(filter_cols=("quality",)))
    return hits.select("question_id", "id", "parent", "score", "rank", "filtered")


def search_approx_recall(spark: SparkSession, sf: str) -> DataFrame:
    """V5, approximate: whether nine in ten hits of the exact search over document chunks are found by buckets."""
    coll = I.document_collection(spark, sf)
    qs = I.embedded_questions(I.benchmark_questions(spark, sf))
    spec = I.text_spec(filter_cols=())
    got = X.recall(X.search_approx(spark, coll, qs, spec), search(spark, coll, qs, spec))
    return got.select("wanted", (F.col("recall") >= 0.9).alias("reached"))


# ---------------------------------------------------------------------------
# Q: retrieval evaluation (benchmark passages inside documents)
# ---------------------------------------------------------------------------

def _doc_eval(spark, sf, spec=None):
    spec = spec or I.text_spec()
    coll = I.document_collection(spark, sf)
    qs = I.embedded_questions(I.benchmark_questions(spark, sf))
    hits, _ = search_bounded(spark, coll, qs, spec)
    det = R.hit_details(hits, coll)
    return qs, _relevant(det, I.whole_chunks(coll), qs)


def _relevant(hits: DataFrame, chunks: DataFrame, qs: DataFrame) -> DataFrame:
    """``relevant``: the whole text that a hit is a window of contains the question's passage."""
    whole = chunks.select("issue_id", F.col("text").alias("_whole"))
    asked = qs.select("question_id", F.col("question").alias("_q"))
    return (hits.join(asked, "question_id").join(whole, "issue_id")
            .withColumn("relevant", F.instr("_whole", F.col("_q")) > 0).drop("_whole", "_q"))


def hit_per_question(spark: SparkSession, sf: str) -> DataFrame:
    """Q2-Q4."""
    qs, det = _doc_eval(spark, sf)
    res = Q.per_question(qs.select("question_id"), det, relevant_col="relevant")
    return res.select("question_id", F.array_join("retrieved_ids", ",").alias("retrieved_ids"),
                      "best_score", "n_results", "hit", Q.label().alias("label"))


def hit_expected(spark: SparkSession, sf: str) -> DataFrame:
    """Q1-Q4 with explicit expected ids; every fifth question has none (N/A)."""
    qs, det = _doc_eval(spark, sf)
    own = F.col("question_id")
    qs = qs.select("question_id", F.when(own % 5 != 0, F.array(own, own * 7, own)).alias("expected_ids"))
    res = Q.per_question(qs, det, expected=Q.expected_from_lists(qs))
    expected = F.coalesce(F.array_sort(F.array_distinct(F.transform("expected_ids", lambda x: x.cast("string")))),
                          F.array().cast("array<string>"))
    return res.select("question_id", F.array_join("retrieved_ids", ",").alias("retrieved_ids"),
                      F.array_join(expected, ",").alias("expected_ids"), Q.label().alias("label"))


def hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Q5."""
    qs, det = _doc_eval(spark, sf)
    return Q.summary(Q.per_question(qs.select("question_id"), det, relevant_col="relevant"))


def hit_rate_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    """Q6: tags derived from the question (length class, and "all")."""
    qs, det = _doc_eval(spark, sf)
    tags = F.array(F.when(F.length("question") < 200, F.lit("short")).otherwise(F.lit("long")), F.lit("all"))
    res = Q.per_question(qs.select("question_id", tags.alias("tags")), det, relevant_col="relevant")
    return Q.by_tag(res)


def _swept(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Questions, and per (k, threshold, question) that got hits whether one of them is relevant."""
    coll = I.document_collection(spark, sf)
    qs = I.embedded_questions(I.benchmark_questions(spark, sf))
    cand = fetch_window(spark, coll, qs, I.text_spec(fallback=False))
    swept = Q.sweep(cand, [1, 3, 5], [None, 1.0])
    rel = _relevant(swept.withColumnRenamed("parent", "issue_id"), I.whole_chunks(coll), qs)
    return qs, rel.groupBy("k", "threshold", "question_id").agg(F.bool_or("relevant").alias("hit"))


def hit_rate_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Q7: hit rate for K in (1, 3, 5) x gate in (none, 1.0)."""
    _, per = _swept(spark, sf)
    return per.groupBy("k", "threshold").agg(F.count(F.lit(1)).alias("answered"), F.count_if("hit").alias("hits"))


def hit_rate_cube(spark: SparkSession, sf: str) -> DataFrame:
    """Q6 + Q7: the sweep by length class of the question, with all totals, in one aggregation."""
    qs, per = _swept(spark, sf)
    tag = F.when(F.length("question") < 200, F.lit("short")).otherwise(F.lit("long"))
    return Q.cube(per, qs.select("question_id", tag.alias("tag"))).withColumn("k", F.coalesce("k", F.lit(0)))


# ---------------------------------------------------------------------------
# T: run-log analytics on the event log
# ---------------------------------------------------------------------------

def stage_share(spark: SparkSession, sf: str) -> DataFrame:
    """runs = users, stages = event types, elapsed = value."""
    e = read_table(spark, sf, "events")
    return T.stage_share(e, "user_id", "event_type", "value")


def rolling_eta(spark: SparkSession, sf: str) -> DataFrame:
    """Per user, the wait implied by the previous 50 durations."""
    e = read_table(spark, sf, "events")
    r = T.rolling_eta(e, "user_id", ["ts", "event_id"], "value")
    return r.select("event_id", "user_id", "mean_duration", "eta")


def throughput(spark: SparkSession, sf: str) -> DataFrame:
    """T3 per event type."""
    return T.throughput(read_table(spark, sf, "events"), "event_type", "ts")


def query_time(spark: SparkSession, sf: str) -> DataFrame:
    """T4: per user, click = extraction, view = retrieval, purchase = generation."""
    return T.query_time(read_table(spark, sf, "events"), "user_id", "event_type", "value",
                        {"extraction": "click", "retrieval": "view", "generation": "purchase"})


# ---------------------------------------------------------------------------
# E: embedding
# ---------------------------------------------------------------------------

def hash_embed_q(spark: SparkSession, sf: str) -> DataFrame:
    """E2 (offline embedder): non-zero buckets of every document's vector."""
    d = I.documents(spark, sf)
    v = d.select("doc_id", hash_embed(F.col("text"), I.EMBED_DIM).alias("v"))
    return (v.select("doc_id", F.posexplode("v").alias("bucket", "w"))
            .where(F.col("w") != 0)
            .select("doc_id", F.col("bucket").cast("bigint").alias("bucket"), F.round("w", 9).alias("w")))


# ---------------------------------------------------------------------------
# The whole question -> answer flow for a batch
# ---------------------------------------------------------------------------

def _answer_flow(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions with their filters, detailed hits, and per question with hits their number and the filters used.

    By their number, questions name nothing, a status, a priority that no
    issue has (so the filters are cleared again), or a status and a project.
    """
    qs = I.benchmark_questions(spark, sf)
    names = F.array(*(F.lit(x) for x in ("", " Which of them are new?", " Only urgent ones, please.",
                                         " Which are resolved, for the kernel?")))
    qs = qs.withColumn("question", F.concat("question", F.element_at(
        names, (F.pmod("question_id", F.lit(4)) + 1).cast("int"))))
    qs = qs.withColumn("response", FL.keyword_response(F.col("question")))
    qs = FL.extract_filters(qs, "response")
    coll = I.conversation_collection(spark, sf)
    hits, _ = search_bounded(spark, coll, I.embedded_questions(qs), I.text_spec())
    # filters are reported only when the filtered search was used
    given = F.to_json(FL.filters_map(F.col("status"), F.col("priority"), F.col("project_id")))
    used = hits.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_hits"), F.bool_or("filtered").alias("_f"))
    used = used.join(qs.select("question_id", given.alias("_given")), "question_id").select(
        "question_id", "n_hits", F.when(F.col("_f"), F.col("_given")).alias("filters"))
    return qs, R.hit_details(hits, coll), used


def answer_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Filters from the (offline) extraction model, filtered search with
    fallback over conversation chunks, prompts, answers from an injected model."""
    qs, det, used = _answer_flow(spark, sf)
    answers = R.generate(R.build_prompts(qs, det), R.citation_model)
    return answers.join(used, "question_id", "left").select(
        "question_id", "answer", F.coalesce("n_hits", F.lit(0)).cast("bigint").alias("n_hits"),
        F.coalesce("filters", F.lit("{}")).alias("filters"))


def _eval_records(spark: SparkSession, sf: str) -> DataFrame:
    """The answer flow judged by expected ids; what each question took is read from the event log (its user's events)."""
    qs, det, used = _answer_flow(spark, sf)
    own = F.col("question_id")
    tag = F.when(F.length("text") < 200, F.lit("short")).otherwise(F.lit("long"))
    tags = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.array(tag).alias("tags"))
    asked = qs.select("question_id", "question", F.when(own % 5 != 0, F.array(own, own * 7, own)).alias("expected_ids"))
    asked = asked.join(tags, "question_id")
    timings = read_table(spark, sf, "events").select(F.col("user_id").alias("question_id"), F.col("value").alias("elapsed"))
    return Q.records(Q.per_question(asked, det, expected=Q.expected_from_lists(asked)),
                     used.select("question_id", "filters"), timings)


def eval_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of an evaluation, written as JSON lines and read back."""
    path = scratch_path(spark, f"eval/{uuid.uuid4().hex}")
    records = _eval_records(spark, sf)
    SQ.write_eval_results(records, path)
    back = spark.read.schema(records.schema).json(path)
    expected = F.array_sort(F.array_distinct(F.transform(F.coalesce("expected_ids", F.array()), lambda x: x.cast("string"))))
    return back.select("question_id", "question", F.array_join("tags", ",").alias("tags"), "filters",
                       F.array_join("retrieved_ids", ",").alias("retrieved_ids"), F.array_join(expected, ",").alias("expected_ids"),
                       F.round("best_score", 6).alias("best_score"), Q.label().alias("label"),
                       F.round("elapsed", 6).alias("elapsed"), "n_results")


def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Q5 with the total time."""
    return Q.summary(_eval_records(spark, sf)).withColumn("total_elapsed", F.round("total_elapsed", 6))
