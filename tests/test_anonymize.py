
from issuelens.operators.anonymize import anonymize_issues, anonymous_name, run_summary, user_mapping
from tests.conftest import base_issue, journal


def test_anonymous_names(spark):
    df = spark.createDataFrame([(1,), (99,), (12345,), (999999,), (None,)], "id bigint")
    got = [r[0] for r in df.select(anonymous_name("id")).collect()]
    assert got == ["User_00001", "User_00099", "User_12345", "User_999999", None]


def test_mapping_first_name_wins(make_issues):
    iss = [base_issue(id=1, author={"id": 10, "name": "Ines"}),
           base_issue(id=2, author={"id": 10, "name": "Ines Again"})]
    rows = user_mapping(make_issues(iss)).collect()
    assert [(r.user_id, r.original_name, r.anonymous_name) for r in rows] == [(10, "Ines", "User_00010")]


def test_mapping_order_inside_issue_and_unknown(make_issues):
    iss = [base_issue(id=1, author={"id": 5, "name": None},
                      journals=[journal(1, "Later", 5, "x")],
                      watchers=[{"id": 6, "name": "W"}, {"id": None, "name": "no id"}])]
    got = {r.user_id: r.original_name for r in user_mapping(make_issues(iss)).collect()}
    assert got == {5: "Unknown", 6: "W"}


def test_anonymize_issue_full(make_issues):
    iss = base_issue(id=4, description="mail me at a@b.com", subject="a@b.com stays",
                     assigned_to={"id": 20, "name": "Bob"},
                     journals=[journal(1, "Bob", 20, "ip 10.0.0.1")], watchers=[{"id": 30, "name": "Dave"}])
    r = anonymize_issues(make_issues([iss])).first()
    assert r.author.name == "User_00031" and r.assigned_to.name == "User_00020"
    assert r.journals[0].user.name == "User_00020" and r.journals[0].notes == "ip [REDACTED-IP]"
    assert r.watchers[0].name == "User_00030"
    assert r.description == "mail me at [REDACTED-EMAIL]" and r.subject == "a@b.com stays"


def test_null_and_idless_users_unchanged(make_issues):
    iss = base_issue(author=None, assigned_to={"id": None, "name": "Ghost"})
    r = anonymize_issues(make_issues([iss])).first()
    assert r.author is None and r.assigned_to.name == "Ghost"


def test_run_summary(make_issues):
    iss = [base_issue(id=1, author={"id": 10, "name": "Ines"}), base_issue(id=2, author={"id": 11, "name": "B"})]
    df = make_issues(iss)
    s = run_summary(df, user_mapping(df)).first()
    assert (s.issues_processed, s.distinct_users, s.sample_author_before, s.sample_author_after) == \
        (2, 2, "Ines", "User_00010")


def test_strict_masks_idless_and_subject(make_issues):
    iss = base_issue(subject="mail a@b.com", assigned_to={"id": None, "name": "Ghost"})
    r = anonymize_issues(make_issues([iss]), strict=True).first()
    assert r.assigned_to.name == "Unknown" and r.subject == "mail [REDACTED-EMAIL]"
