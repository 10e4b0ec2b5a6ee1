from pyspark.sql import functions as F

from issuelens import config as C
from issuelens.operators import answer as R
from issuelens.operators import filters as FL

RESPONSES = [
    ('{"status": "Rejected"}', ("Rejected", None, None)),
    ('{"status": "Imaginary"}', (None, None, None)),
    ('{"priority": "Critical"}', (None, None, None)),
    ("{}", (None, None, None)),
    ("not json at all", (None, None, None)),
    (None, (None, None, None)),
    ('```json\n{"priority": "High"}\n```', (None, "High", None)),
    ('```\n{"status": "New"}\n```', ("New", None, None)),
    ('{"project": "kernel"}', (None, None, "qe-kernel")),
    ('{"project": " Containers "}', (None, None, "containers")),
    ('{"project": "unknown-project"}', (None, None, None)),
    ('{"status": "Closed", "priority": "Urgent", "project": "yast"}', ("Closed", "Urgent", "qe-yast")),
    ("[1, 2]", (None, None, None)),
    ("{'status': 'New'}", (None, None, None)),
    ('  {"status": "Feedback"}  ', ("Feedback", None, None)),
]


def test_parse_and_validate(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(RESPONSES)], "question_id bigint, response string")
    got = {r.question_id: (r.status, r.priority, r.project_id)
           for r in FL.extract_filters(df).collect()}
    assert [got[i] for i in range(len(RESPONSES))] == [w for _, w in RESPONSES]


def test_predicate_and_map(spark):
    assert FL.predicate({}) is None
    df = spark.createDataFrame([("New", "High"), ("New", "Low")], "status string, priority string")
    assert df.where(FL.predicate({"status": "New", "priority": "High"})).count() == 1
    m = spark.range(1).select(FL.filters_map(F.lit("New"), F.lit(None).cast("string"), F.lit("qam"))).first()[0]
    assert m == {"status": "New", "project_id": "qam"}


def test_extraction_prompt(spark):
    p = spark.range(1).select(FL.extraction_prompt(F.lit("Any high priority bugs?"))).first()[0]
    assert p.startswith("Extract any Redmine metadata filters") and "Question: Any high priority bugs?" in p
    assert p.endswith("Respond with only the JSON object, no explanation.\n")


def test_keyword_responder_round_trip(spark):
    df = spark.createDataFrame([(1, "Show me rejected issues in kernel"), (2, "What is new?"), (3, "nothing")],
                               "question_id bigint, question string")
    df = df.withColumn("response", FL.keyword_response(F.col("question")))
    got = {r.question_id: (r.status, r.project_id) for r in FL.extract_filters(df).collect()}
    assert got == {1: ("Rejected", "qe-kernel"), 2: ("New", None), 3: (None, None)}


def test_prompt_blocks_and_placeholders(spark):
    qs = spark.createDataFrame([(1, "why?"), (2, "none?")], "question_id bigint, question string")
    hits = spark.createDataFrame(
        [(1, 2, "  second text ", "7", "P", None, "High", "c", "u"), (1, 1, "first", "5", "P", "New", "Low", "c", "u")],
        "question_id bigint, rank bigint, text string, issue_id string, project string, status string, "
        "priority string, created_on string, updated_on string")
    got = {r.question_id: r.prompt for r in R.build_prompts(qs, hits).collect()}
    assert got[2] == "--- Retrieved Issues ---\n(no issues retrieved)\n--- End of Issues ---\n\nQuestion: none?\n"
    b1 = "[Issue #5 | P | New | Low | created: c | updated: u]\nfirst\n"
    b2 = "[Issue #7 | P | ? | High | created: c | updated: u]\nsecond text\n"
    assert got[1] == "--- Retrieved Issues ---\n" + b1 + "\n---\n" + b2 + "\n--- End of Issues ---\n\nQuestion: why?\n"


def test_source_cards(spark):
    hits = spark.createDataFrame(
        [(1, 1, "42", "s" * 200, "P", "p", "New", "Normal", "2024-01-15T10:00:00Z", "2024-06-20T14:30:00Z",
          0.123456, "  body  ")],
        "question_id bigint, rank bigint, issue_id string, subject string, project string, project_id string, "
        "status string, priority string, created_on string, updated_on string, score double, text string")
    r = R.source_cards(hits, "https://tracker.example/").first()
    assert r.issue_url == "https://tracker.example/issues/42" and len(r.subject) == 120
    assert (r.created_on, r.updated_on, r.score_text, r.snippet) == ("2024-01-15", "2024-06-20", "0.1235", "body")
    assert r.priority_badge is None


def test_generate_with_injected_model(spark):
    prompts = spark.createDataFrame([(1, "[Issue #5 | a]\nx"), (2, "nothing")], "question_id bigint, prompt string")
    got = {r.question_id: r.answer for r in R.generate(prompts, R.citation_model).collect()}
    assert got[1] == "Relevant issues: (Issue #5)" and "not contain" in got[2]


def test_numbered_results(spark):
    df = spark.createDataFrame([(i, f"q{i}") for i in (5, 1, 3)], "question_id bigint, question string")
    rows = sorted((r.position, r.header) for r in R.numbered_results(df.repartition(3)).collect())
    assert rows == [(1, "=== Q1/3: q1 ==="), (2, "=== Q2/3: q3 ==="), (3, "=== Q3/3: q5 ===")]


def test_text_around_the_object_is_no_filter(spark):
    cases = [('{"status": "New"}', "New"), (' {"status": "New"} \n', "New"),
             ('```json\n{"status": "New"}\n```', "New"),
             ('{"status": "New"}\nThis filters new issues.', None),
             ('{"status": "New"} {"status": "Closed"}', None), ('{"status": "New"}, {"status": "Closed"}', None),
             ('[{"status": "New"}]', None), ("{'status': 'New'}", None), ("{}", None), ("", None), (None, None)]
    rows = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, response string")
    got = {r.i: r.status for r in FL.extract_filters(rows).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_nothing_may_follow_the_object(spark):
    from issuelens.operators.filters import parse_response

    ok = '{"status": "New"}'
    texts = [ok, f" {ok}\n", '{"status": "New", "project": "a } ] b \\" {"}', '{"status": "New", "x": {"y": [1, {}]}}',
             "```json\n" + ok + "\n```", ok + "]", ok + "] and so on", ok + "], [" + ok, ok + "," + ok, ok + "}", "{" + ok,
             ok + " x", "[" + ok + "]", ok + '"', "", "{", "}{", "x" + ok, "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i for r in df.withColumn("r", parse_response("t")).where("r.status = 'New'").collect()}
    assert got == {0, 1, 2, 3, 4}
