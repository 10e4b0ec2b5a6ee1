import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from issuelens.llm import quality as Q

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(text):
    text = text or ""
    words = SPACE.findall(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def rejected(text):
    """Names of all rules that reject a text, by plain Python."""
    n, chars, symbols, dup, _ = measures(text)
    lines = [x for x in (text or "").split("\n")]
    full = sum(bool(SPACE.search(x)) for x in lines)
    out = set()
    if chars < 2 * n or chars > 15 * n:
        out.add("word_length")
    if 10 * symbols > n:
        out.add("symbols")
    if dup > 1 and 10 * dup > 3 * full:
        out.add("repeated_lines")
    if 10 * sum(bool(re.search(r"^[\x20\x09-\x0D]*[-*•‣◦⁃]", x)) for x in lines) > 9 * full:
        out.add("bullets")
    if 10 * sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*\Z", x)) for x in lines) > 3 * full:
        out.add("cut_off_lines")
    if 10 * sum(any(c.isalpha() for c in w) for w in SPACE.findall(text or "")) < 7 * n:
        out.add("words_without_letter")
    return out


def base_failed(text):
    n, repeats = measures(text)[0], measures(text)[-1]
    return n < 50 or 100 * repeats > 50 * n


@pytest.fixture(scope="module")
def varied(texts):
    plain = [" ".join(f"word{chr(97 + i % 26)}{i}é" for i in range(k, k + 60)) for k in (0, 7)]
    bullets = "\n".join(f"- item number{i} has several words here{i}" for i in range(20))
    cut = "\n".join(f"line{i} stops{i} long{i} before it{i} ends ..." for i in range(12))
    numbers = " ".join(str(i) for i in range(80)) + " " + plain[0][:40]
    symbols = " ".join(f"w{i}#" for i in range(90))
    lines = "\n".join([f"one repeated line with words {i % 3}" for i in range(9)] + [plain[0]])
    short = " ".join(chr(97 + i % 26) for i in range(20)) + " " + " ".join("abcdefghijklmnop"[i % 9:i % 9 + 1] for i in range(60))
    return texts + plain + [bullets, cut, numbers, symbols, lines, short, plain[0].replace(" ", "  "), "x" * 5000,
                            " ".join(["a b c"] * 30), "a b c d a b c", "a a a a", "𝔘𝔫 𝔦 " * 30]


def test_measures_and_verdicts_of_every_text(spark, varied):
    df = spark.createDataFrame(list(enumerate(varied)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in Q.judge(spark, df).collect()}
    assert len(rows) == len(varied)
    for i, t in enumerate(varied):
        r = rows[i]
        assert tuple(r[m] for m in MEASURES) == measures(t), t
        assert r.base_failed == base_failed(t)
        assert r.kept == (not base_failed(t) and not rejected(t)), (t, r.rejected_by)
        assert r.text == t
        assert r.rejected_by is None if r.kept or r.base_failed else r.rejected_by in rejected(t)
    assert {r.rejected_by for r in rows.values()} > {"bullets", "cut_off_lines", "words_without_letter", "symbols", "repeated_lines"}


def test_order_is_rejection_by_cost_and_counts_what_is_left(spark, monkeypatch):
    sample = spark.createDataFrame([(i, "x") for i in range(100)], "n long, text string")
    rules = [Q.Rule("dear", "n < 60"), Q.Rule("cheap", "n < 40"), Q.Rule("repeat", "n < 39"), Q.Rule("other", "n >= 95"),
             Q.Rule("null", "n > null")]
    price = {"n < 60": 5.0, "n < 40": 1.0, "n < 39": 1.0, "n >= 95": 1.0, "n > null": 1.0}
    monkeypatch.setattr(Q, "_seconds", lambda sample, condition: price.get(condition, 0.0))
    got = Q.plan(sample, rules)
    # 40 a second first; then 5 for a second before 20 for five; what "cheap" has already taken counts no more
    assert [e.rule.name for e in got] == ["cheap", "other", "dear", "repeat", "null"]
    assert [e.rejected for e in got] == [0.4, 0.05, 0.6, 0.39, 0.0]


def test_later_rules_are_not_evaluated(spark):
    df = spark.createDataFrame([(1,), (2,)], "n long")
    order = [Q.Rule("first", "n > 0"), Q.Rule("fails", "raise_error('evaluated') is null")]
    assert [r.r for r in df.select(Q.rejected_by(order).alias("r")).collect()] == ["first", "first"]


def test_any_order_keeps_the_same(spark, varied, monkeypatch):
    df = spark.createDataFrame(list(enumerate(varied)), "doc_id long, text string")
    kept = {r.doc_id for r in Q.judge(spark, df).where("kept").collect()}
    assert kept == {r.doc_id for r in Q.judge(spark, df, Q.RULES[::-1], sample=3).where("kept").collect()}
    assert kept < {r.doc_id for r in Q.judge(spark, df, ()).where("kept").collect()}


def test_odd_rows(spark, odd, none):
    rows = [r.asDict() for r in Q.judge(spark, odd.withColumn("rejected_by", F.lit(7))).collect()]
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in rows) == sorted(
        (str(i), n) for i, n in [(0, 16), (1, 16), (2, 0), (3, 0), (4, 0), (5, 60_000), (5, 60_000), (None, 16), (None, 0),
                                 (6, 2), (7, 40)])
    assert {r["lang_pred"] for r in rows} == {"mine"}
    assert [r["text"] for r in rows if r["doc_id"] == 2] == [None]
    assert all(measures(r["text"]) == tuple(r[m] for m in MEASURES) for r in rows)
    assert Q.judge(spark, none).count() == 0


def test_another_text_column(spark, varied):
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(varied)], "doc_id long, body string, text string")
    rows = Q.judge(spark, df, text="body").collect()
    assert all((r.body, r.text) == (varied[r.doc_id], "own") and r.n_words == measures(r.body)[0] for r in rows)
    assert "text" not in Q.judge(spark, df.drop("text"), text="body").columns
