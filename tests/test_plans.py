"""Plan-shape checks: the properties the design relies on at scale."""

import io
import re
from contextlib import redirect_stdout

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def joins_blocks_only(p: str) -> bool:
    """At most one join without keys, of packed collection blocks with packed question blocks."""
    loops = re.findall(r"\(\d+\) (?:BroadcastNestedLoopJoin|CartesianProduct)", p)
    packed = re.search(r"MapInArrow\nInput[^\n]*\nArguments: kernel[^\n]*", p)
    return len(loops) <= 1 and bool(packed) and "vecs" in p and "qvecs" in p


def test_search_joins_blocks_and_has_one_exchange_by_question(spark):
    p = plan(E.queries()["search"](spark, SF))
    assert joins_blocks_only(p)
    assert len(re.findall(r"Exchange hashpartitioning\(question_id", p)) <= 1


def test_kernel_scan_reads_no_text(spark):
    p = plan(E.queries()["source_list"](spark, SF))
    scans = re.findall(r"ReadSchema: (struct<[^\n]*>)", p)
    kernel_scans = [s for s in scans if "embedding" in s]
    assert kernel_scans and all("text:" not in s for s in kernel_scans)
    assert joins_blocks_only(p)


def test_filters_reach_the_scan(spark):
    p = plan(E.queries()["changed_since"](spark, SF))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts", p)
    p = plan(E.queries()["project_union"](spark, SF))
    assert re.search(r"PushedFilters: \[.*In\(event_type", p)


def test_upsert_and_mapping_aggregate_partially(spark):
    for q in ("merge_upsert", "user_mapping", "dedup_last"):
        p = plan(E.queries()[q](spark, SF))
        assert "partial_max_by" in p or "partial_min_by" in p, q


def test_labelled_search_scans_metadata_not_text(spark):
    from issuelens.operators.search import _filtered_plans, question_blocks
    from issuelens.plans import inputs as I

    coll = I.labelled_collection(spark, SF)
    qs = I.embedded_questions(I.benchmark_questions(spark, SF)).selectExpr("*", "'1' AS quality")
    spec = I.text_spec(filter_cols=("quality",))
    filtered, = _filtered_plans(coll, question_blocks(spark, qs, spec.filter_cols), spec)
    p = plan(filtered)
    scans = [s for s in re.findall(r"ReadSchema: (struct<[^\n]*>)", p) if "embedding" in s]
    assert scans and all("quality:" in s and "text:" not in s for s in scans)
    assert re.search(r"PushedFilters: \[.*EqualTo\(quality,1\)|PushedFilters: \[.*In\(quality", p)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
