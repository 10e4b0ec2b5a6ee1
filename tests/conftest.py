import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from issuelens.schemas import ISSUE  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from issuelens.session import ensure_checkpoint_dir

    s = (SparkSession.builder.master("local[4]")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    from issuelens.session import ship_package

    ship_package(s)
    yield s


def _user(u):
    if u is None:
        return None
    return (u.get("id"), u.get("name"))


def issue_row(d: dict, seq: int):
    def named(k):
        v = d.get(k)
        return None if v is None else (v.get("id"), v.get("name"))

    journals = d.get("journals")
    if journals is not None:
        journals = [(j.get("id"), _user(j.get("user")), j.get("notes"), j.get("created_on")) for j in journals]
    watchers = d.get("watchers")
    if watchers is not None:
        watchers = [_user(w) for w in watchers]
    return (d.get("id"), d.get("subject"), d.get("description"), named("status"), named("priority"),
            named("tracker"), named("project"), d.get("project_identifier"), d.get("created_on"),
            d.get("updated_on"), _user(d.get("author")), _user(d.get("assigned_to")), journals, watchers, seq)


@pytest.fixture(scope="session")
def make_issues(spark):
    from pyspark.sql import types as T

    schema = T.StructType(list(ISSUE.fields) + [T.StructField("seq", T.LongType())])

    def make(dicts):
        return spark.createDataFrame([issue_row(d, i) for i, d in enumerate(dicts)], schema)

    return make


def base_issue(**kw):
    """An issue with every field but comments and watchers."""
    d = {
        "id": 1, "subject": "Cache fills the disk", "description": "It grows every night",
        "status": {"id": 4, "name": "Feedback"}, "priority": {"id": 3, "name": "Normal"},
        "tracker": {"id": 7, "name": "Defect"}, "project": {"id": 12, "name": "Storage"},
        "project_identifier": "storage",
        "created_on": "2023-03-04T05:06:07Z", "updated_on": "2023-08-09T10:11:12Z",
        "author": {"id": 31, "name": "Dana"}, "assigned_to": None, "journals": [], "watchers": [],
    }
    d.update(kw)
    return d


def journal(i, name, uid, notes):
    return {"id": i, "user": {"id": uid, "name": name}, "notes": notes, "created_on": "2024-02-01T00:00:00Z"}
