"""Driver tables -> the issue model.

The test data has no tracker export, so issue-shaped rows are derived from
the given tables.  The mapping rules below are part of the engine's test
contract (the oracle SQL repeats them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.functions.text import first_line
from issuelens.schemas import ISSUE_FIELDS

# Fixed adapter values: conversation role -> user id.
ROLE_USER_IDS = {"system": 1, "user": 2, "assistant": 3}
# Fixed adapter values: order status / priority -> tracker vocabulary.
ORDER_STATUS = {"F": "Closed", "O": "New", "P": "In Progress"}
ORDER_PRIORITY = {"1-URGENT": "Immediate", "2-HIGH": "Urgent", "3-MEDIUM": "High",
                  "4-NOT SPECIFIED": "Normal", "5-LOW": "Low"}

ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"
EMPTY_JOURNALS = "array<struct<id:bigint,user:struct<id:bigint,name:string>,notes:string,created_on:string>>"
EMPTY_USERS = "array<struct<id:bigint,name:string>>"
NAMED_TYPE = "struct<id:bigint,name:string>"


def _lookup(c: Column, table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def _named(name: Column, id_: Column | None = None) -> Column:
    return F.when(name.isNotNull(), F.struct(
        (id_ if id_ is not None else F.lit(None)).cast("bigint").alias("id"),
        name.alias("name"))).cast(NAMED_TYPE)


def _role_user(role: Column) -> Column:
    return F.struct(_lookup(role, ROLE_USER_IDS).cast("bigint").alias("id"), role.alias("name"))


def _project_of(key: Column) -> Column:
    """Spread numeric keys over the configured projects."""
    return F.element_at(F.array(*[F.lit(p) for p in C.PROJECT_IDS]),
                        (F.pmod(key, F.lit(len(C.PROJECT_IDS))) + 1).cast("int"))


def priority_of(key: Column) -> Column:
    """Conversations are of three priorities in turn."""
    return F.when(key % 3 == 0, "Normal").when(key % 3 == 1, "High").otherwise("Low")


def conversation_issues(conv: DataFrame) -> DataFrame:
    """One issue per ``conv_id``: first turn = subject/description, later turns = journals.

    An issue is one row here, its journals an array: for tables whose
    conversations are known to be short.  The registered queries work on the
    turn rows instead (``operators.turns``).
    """
    turns = (conv.groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t")))
    first = F.col("t")[0]
    later = F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0)))
    last_role = F.element_at("t", -1).getField("role")
    journals = F.transform(later, lambda x: F.struct(
        x.getField("turn").alias("id"),
        _role_user(x.getField("role")).alias("user"),
        x.getField("text").alias("notes"),
        F.lit(None).cast("string").alias("created_on"),
    ))
    project = _project_of(F.col("conv_id"))
    return turns.select(
        F.col("conv_id").alias("id"),
        first_line(first.getField("text")).alias("subject"),
        first.getField("text").alias("description"),
        _named(F.when(last_role == "assistant", F.lit("Resolved")).otherwise(F.lit("New"))).alias("status"),
        _named(priority_of(F.col("conv_id"))).alias("priority"),
        _named(F.lit("Support")).alias("tracker"),
        _named(project).alias("project"),
        project.alias("project_identifier"),
        F.lit(None).cast("string").alias("created_on"),
        F.lit(None).cast("string").alias("updated_on"),
        _role_user(first.getField("role")).alias("author"),
        F.lit(None).cast(NAMED_TYPE).alias("assigned_to"),
        journals.cast(EMPTY_JOURNALS).alias("journals"),
        F.array().cast(EMPTY_USERS).alias("watchers"),
        F.col("conv_id").alias("seq"),
    )


def conversation_issue_summary(conv: DataFrame) -> DataFrame:
    """Issue rows of the conversations without the journal array.

    Carries ``n_journals`` instead: every field comes from partial
    aggregates (count, first turn, last role), so a conversation holding a
    third of all turns is never gathered into one row.  Use it wherever
    only the journal count is needed.
    """
    g = conv.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by(F.struct("role", "text"), F.col("turn")).alias("_first"),
        F.max_by(F.col("role"), F.col("turn")).alias("_last_role"),
    )
    project = _project_of(F.col("conv_id"))
    return g.select(
        F.col("conv_id").alias("id"),
        first_line(F.col("_first.text")).alias("subject"),
        F.col("_first.text").alias("description"),
        _named(F.when(F.col("_last_role") == "assistant", F.lit("Resolved")).otherwise(F.lit("New"))).alias("status"),
        _named(priority_of(F.col("conv_id"))).alias("priority"),
        _named(F.lit("Support")).alias("tracker"),
        _named(project).alias("project"),
        project.alias("project_identifier"),
        F.lit(None).cast("string").alias("created_on"),
        F.lit(None).cast("string").alias("updated_on"),
        _role_user(F.col("_first.role")).alias("author"),
        F.lit(None).cast(NAMED_TYPE).alias("assigned_to"),
        F.lit(None).cast(EMPTY_JOURNALS).alias("journals"),
        F.array().cast(EMPTY_USERS).alias("watchers"),
        F.col("conv_id").alias("seq"),
        (F.col("_n") - 1).cast("bigint").alias("n_journals"),
    )


def document_issues(docs: DataFrame) -> DataFrame:
    """Description-only issues: ``source`` is the project, ``lang`` the tracker."""
    return docs.select(
        F.col("doc_id").alias("id"),
        first_line("text").alias("subject"),
        F.col("text").alias("description"),
        F.lit(None).cast(NAMED_TYPE).alias("status"),
        F.lit(None).cast(NAMED_TYPE).alias("priority"),
        _named(F.col("lang")).alias("tracker"),
        _named(F.col("source")).alias("project"),
        F.col("source").alias("project_identifier"),
        F.lit(None).cast("string").alias("created_on"),
        F.lit(None).cast("string").alias("updated_on"),
        F.lit(None).cast(NAMED_TYPE).alias("author"),
        F.lit(None).cast(NAMED_TYPE).alias("assigned_to"),
        F.array().cast(EMPTY_JOURNALS).alias("journals"),
        F.array().cast(EMPTY_USERS).alias("watchers"),
        F.col("doc_id").alias("seq"),
    )


def order_issues(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Orders as issues: status/priority mapped, the customer is the author, the next one (by number) may watch.

    The customer table grows with the data, so no broadcast is forced;
    AQE turns the join into a broadcast at run time when it is small.
    """
    cust = customer.select("c_custkey", "c_name", "c_mktsegment")
    o = orders.join(cust, orders.o_custkey == cust.c_custkey, "left")
    ts = F.date_format("o_orderdate", ISO_UTC)
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("subject"),
        F.lit(None).cast("string").alias("description"),
        _named(_lookup(F.col("o_orderstatus"), ORDER_STATUS)).alias("status"),
        _named(_lookup(F.col("o_orderpriority"), ORDER_PRIORITY)).alias("priority"),
        _named(F.lit("Bug")).alias("tracker"),
        _named(F.lower("c_mktsegment")).alias("project"),
        F.lower("c_mktsegment").alias("project_identifier"),
        ts.alias("created_on"),
        ts.alias("updated_on"),
        F.when(F.col("c_custkey").isNotNull(),
               F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))).alias("author"),
        F.lit(None).cast(NAMED_TYPE).alias("assigned_to"),
        F.array().cast(EMPTY_JOURNALS).alias("journals"),
        F.when(F.col("o_custkey") % 5 > 0, F.array(F.struct((F.col("o_custkey") + 1).alias("id"), F.concat(
            F.lit("Watcher "), (F.col("o_custkey") + 1).cast("string")).alias("name"))))
        .otherwise(F.array()).cast(EMPTY_USERS).alias("watchers"),
        F.col("o_orderkey").alias("seq"),
    )


def event_versions(events: DataFrame) -> DataFrame:
    """Update log: each event is a new version of issue ``user_id``.

    ``seq`` orders versions (time, then event id); ``event_type`` is the
    project the update came from.
    """
    return events.select(
        F.col("user_id").alias("id"),
        F.col("event_id"),
        F.col("ts").alias("updated_ts"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("updated_on"),
        F.col("event_type").alias("project_identifier"),
        F.col("value"),
    )


def issue_columns() -> list[str]:
    return list(ISSUE_FIELDS) + ["seq"]
