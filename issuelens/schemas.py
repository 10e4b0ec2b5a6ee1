"""Fixed schemas of the issue model and its derived tables."""

from __future__ import annotations

from pyspark.sql import types as T

USER = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
])

NAMED = USER  # status / priority / tracker / project objects share the shape

JOURNAL = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("user", USER),
    T.StructField("notes", T.StringType()),
    T.StructField("created_on", T.StringType()),
])

ISSUE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("subject", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("status", NAMED),
    T.StructField("priority", NAMED),
    T.StructField("tracker", NAMED),
    T.StructField("project", NAMED),
    T.StructField("project_identifier", T.StringType()),
    T.StructField("created_on", T.StringType()),
    T.StructField("updated_on", T.StringType()),
    T.StructField("author", USER),
    T.StructField("assigned_to", USER),
    T.StructField("journals", T.ArrayType(JOURNAL)),
    T.StructField("watchers", T.ArrayType(USER)),
])

ISSUE_FIELDS = [f.name for f in ISSUE.fields]

# Chunk metadata kept as top-level columns so filters reach the scan.
META_FIELDS = (
    "issue_id", "subject", "status", "priority", "tracker", "project",
    "project_id", "created_on", "updated_on", "author", "assigned_to",
    "num_journals",
)

CHUNK = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("text", T.StringType())]
    + [T.StructField(m, T.LongType() if m == "num_journals" else T.StringType())
       for m in META_FIELDS]
    + [T.StructField("chunk_index", T.IntegerType()),
       T.StructField("is_description", T.BooleanType())]
)

USER_MAPPING = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("original_name", T.StringType()),
    T.StructField("anonymous_name", T.StringType()),
])

QUESTION_JSON = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("expected_ids", T.ArrayType(T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

LOAD_CHECKPOINT = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("total", T.LongType()),
    T.StructField("successful_ids", T.ArrayType(T.LongType())),
    T.StructField("failed_ids", T.MapType(T.StringType(), T.IntegerType())),
])

SYNC_STATE = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("last_synced_at", T.StringType()),
    T.StructField("sync_count", T.IntegerType()),
])

