"""Derived inputs shared by the registered queries (all read whole tables)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.functions.text import id_text
from issuelens.functions.vector import l2_normalize
from issuelens.operators import documents as D
from issuelens.operators.anonymize import anonymize_issues
from issuelens.operators.embed import HashEmbedder, embed
from issuelens.operators.turns import conversation_chunks as conversation_chunks_from_turns
from issuelens.sources import adapters as A
from issuelens.operators.collection import COLLECTION_SCHEMA
from issuelens.operators.tables import file_system
from issuelens.session import scratch_path
from issuelens.sources.tables import read_table, spread, table_path

# Parameters of the registered queries (chosen once; see README).
CUTOFF = "2024-01-15"                 # since / existing-vs-incoming split of the event log
EARLY = "2024-01-01 06:00:00"          # a few hours into the log: most issues are still to come
# What stands for a template marker and for noise in the test texts
MARKER = r"released under the \w+ license"
NOISE = C.PII_RULES[1][1]
RUN_STARTED_AT = "2024-02-01T00:00:00Z"
EVENT_PROJECTS = ("view", "click", "purchase", "error", "signup")
UNION_PROJECTS = ("error", "click", "view")
JOURNALS_ONLY = ("openqatests", "src0", "src1")
EMBED_DIM = 64
# A7 with a parameterised pattern: the noise-URL rule aimed at the hosts of
# the `pages` table; the other rules stay the fixed ones, in order.
PAGE_URL_RULE = ("page_url", r"https?://[a-z0-9.\-]*example\.(?:com|net|org)\S*", "[PAGE-URL]")
PAGE_RULES = (PAGE_URL_RULE,) + tuple(r for r in C.PII_RULES if r[0] != "openqa_url")
# squared-L2 gate of the registered gate/fallback queries (centroid questions
# sit ~1.1-1.3 from their nearest vectors, so some pass and some fall back)
GATE = 1.3


def conv_issues(spark: SparkSession, sf: str) -> DataFrame:
    return A.conversation_issues(read_table(spark, sf, "conversations"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents table, spread over all cores when the scan has too few splits."""
    return spread(read_table(spark, sf, "documents"))


def doc_issues(spark: SparkSession, sf: str) -> DataFrame:
    return A.document_issues(documents(spark, sf))


def order_issues(spark: SparkSession, sf: str) -> DataFrame:
    return A.order_issues(spread(read_table(spark, sf, "orders")), read_table(spark, sf, "customer"))


def conv_summary(spark: SparkSession, sf: str) -> DataFrame:
    return A.conversation_issue_summary(read_table(spark, sf, "conversations"))


def all_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation issues followed by document issues (M4 order), with
    ``n_journals`` in place of gathered journal arrays."""
    cols = A.issue_columns() + ["n_journals"]
    docs = doc_issues(spark, sf).withColumn("n_journals", F.lit(0).cast("bigint"))
    return conv_summary(spark, sf).select(*cols).unionByName(docs.select(*cols))


def versions(spark: SparkSession, sf: str) -> DataFrame:
    v = A.event_versions(read_table(spark, sf, "events"))
    return v.withColumn("seq", F.struct("updated_ts", "event_id"))


def label_questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question per label: the unit-length mean of its vectors.

    Element-wise mean via posexplode + groupBy(label, pos): partial
    aggregation keeps a dominant label cheap; the regrouped array per label
    has exactly ``dim`` entries.
    """
    e = read_table(spark, sf, "embeddings")
    el = e.select("label", F.posexplode("embedding").alias("pos", "x"))
    means = el.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vec = (means.groupBy("label")
           .agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("pm"))
           .select("label", F.transform("pm", lambda s: s.getField("m")).alias("v")))
    return vec.select(F.col("label").cast("bigint").alias("question_id"),
                      l2_normalize("v").alias("vector"),
                      F.col("label").cast("string").alias("label"))


def embedding_collection(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"),
                    F.floor(F.col("vec_id") / 4).cast("string").alias("parent"),
                    F.col("label").cast("string").alias("label"),
                    F.col("embedding"))


def conversation_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Anonymised, scrubbed conversation issues -> whole chunks, for windows to be embedded.

    Built from the turn rows (skew-safe: no conversation is gathered into
    one row); equal to chunking the nested conversation issues.
    """
    return conversation_chunks_from_turns(read_table(spark, sf, "conversations"),
                                          C.JOURNALS_PER_CHUNK, None, anonymize=True)


def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    issues = anonymize_issues(doc_issues(spark, sf))
    return D.prepare_chunks(issues, C.JOURNALS_PER_CHUNK, None)


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf: str, name: str, tables: tuple[str, ...], build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` as a written table of the shared folder, made once per application and state of its source tables.

    The state is the files of the tables with their sizes and times: a table
    that changed, or a stored one that is gone, is built again.
    """
    state = []
    for table in tables:
        fs, path = file_system(spark, table_path(sf, table))
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            state.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    key = (spark.sparkContext.applicationId, name, "\n".join(sorted(state)))
    path = _STORED.get(key)
    if path is not None:
        fs, done = file_system(spark, f"{path}/_SUCCESS")
        if fs.exists(done):
            return spark.read.parquet(path)
    df = build()
    path = scratch_path(spark, f"stored/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _STORED[key] = path
    return spark.read.schema(df.schema).parquet(path)


def text_collection(chunks: DataFrame, extra_cols: tuple[str, ...] = ()) -> DataFrame:
    """Windows of whole chunks + hash embeddings in the search layout (parent = issue id)."""
    emb = embed(D.embed_windows(chunks), HashEmbedder(EMBED_DIM), "window", None)
    return emb.select(*COLLECTION_SCHEMA.names, *extra_cols).withColumn("parent", F.col("issue_id"))


def conversation_collection(spark: SparkSession, sf: str) -> DataFrame:
    """The embedded collection of the conversations (the ingest step, once per state of the table)."""
    return stored(spark, sf, "conversation-collection", ("conversations",),
                  lambda: text_collection(conversation_chunks(spark, sf)))


def document_collection(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "document-collection", ("documents",), lambda: text_collection(document_chunks(spark, sf)))


def labelled_collection(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "labelled-collection", ("documents", "labels"),
                  lambda: text_collection(labelled_document_chunks(spark, sf), ("quality", "toxic")))


def whole_chunks(collection: DataFrame) -> DataFrame:
    """The chunks of a collection, each once with its whole text."""
    return collection.where("part = 0").withColumn("id", F.col("chunk_id"))


def labelled_document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Document chunks with the ``labels`` table as metadata (``quality``,
    ``toxic`` as strings; NULL for unlabelled documents), joined at ingest
    so the collection carries them as top-level, filterable columns."""
    lab = read_table(spark, sf, "labels").select(
        id_text("doc_id").alias("issue_id"),
        F.col("quality").cast("string").alias("quality"),
        F.col("toxic").cast("string").alias("toxic"))
    return document_chunks(spark, sf).join(lab, "issue_id", "left")


def benchmark_questions(spark: SparkSession, sf: str) -> DataFrame:
    b = read_table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def embedded_questions(questions: DataFrame) -> DataFrame:
    return questions.withColumn("vector", HashEmbedder(EMBED_DIM).column(F.col("question")))


def text_spec(**kw):
    """Search settings of the text pipelines: ingest defaults plus the
    embedder's model tag, so a collection of another model is refused."""
    from issuelens.operators.search import SearchSpec

    extra = {"embed_model": HashEmbedder(EMBED_DIM).name()}
    return SearchSpec(**{"top_k": C.TOP_K, **kw, "extra": extra})
