import pytest

import corpus_pipeline as P
from issuelens.llm import blocks, decontaminate, minhash, substring_dedup, toxicity
from tests.llm.conftest import DOCUMENTS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in P.STAGES:
        after = blocks.scratch_table(spark, stage(spark, docs, SF), f"test-{name}")
        out[name] = (docs, after)
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_return_documents_until_the_last(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name
    assert set(stages["mixing"][1].columns) >= {"doc_id", "size", "source_size", "target", "taken"}
    assert ids(stages["mixing"][1]) == ids(stages["mixing"][0])


def test_decisions_take_effect(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == ids(toxicity.score_documents(spark, before, model).where("score < 0.5"))
    before, after = stages["near_duplicates"]
    assert ids(after) == ids(minhash.near_duplicates(spark, before).where("kept or root is null"))
    before, after = stages["substring_dedup"]
    want = {r.doc_id: r.text for r in substring_dedup.substring_dedup(spark, before).collect()}
    assert {r.doc_id: r.text for r in after.collect()} == want
    before, after = stages["decontamination"]
    found = decontaminate.find_contamination(spark, before, spark.read.parquet(f"{SF}/benchmark.parquet"))
    clean = {r.doc_id: r.text for r in found.where("n_hit = 0").collect()}
    texts = {r.doc_id: r.text for r in after.collect()}
    assert all(texts[i] == t for i, t in clean.items())
    again = decontaminate.find_contamination(spark, after, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert again.where("n_hit > 0").count() == 0


def test_run_gives_the_last_stage(spark, stages):
    rows = lambda df: sorted((r.doc_id, r["size"], r.taken) for r in df.collect())
    assert rows(P.run(spark, SF)) == rows(stages["mixing"][1])


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        after = blocks.scratch_table(spark, stage(spark, docs, SF), "test-empty")
        assert after.count() == 0
        docs = after if "text" in after.columns else docs


def words(seed, n=60):
    return " ".join(f"w{(seed * 7919 + i * i) % 10007}x{seed}" for i in range(n))


def test_copies_are_judged_by_row(spark):
    a, b, c, d = (words(k) for k in range(4))
    rows = [(1, a), (5, a), (5, b), (None, c), (None, c), (7, c), (None, d), (None, d), (8, None), (8, ""), (9, None),
            (2, b[:-3] + "zzz")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENTS).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in P.drop_near_duplicates(spark, docs, SF).collect()), key=str)
    # (5, b) goes for (2, b with another last word); of the three c the one with an id stays, of the two d one
    assert got == sorted([(1, a), (2, b[:-3] + "zzz"), (7, c), (None, d), (8, None), (8, ""), (9, None)], key=str)


def test_a_text_under_a_shared_id_stays(spark):
    a, b = words(1), words(2)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [(1, a), (5, a), (5, b)]], DOCUMENTS)
    assert sorted((r.doc_id, r.text) for r in P.drop_near_duplicates(spark, docs, SF).collect()) == [(1, a), (5, b)]


def test_columns_of_the_user_come_back(spark, odd):
    named = odd.selectExpr("*", "'mine' AS root", "'mine' AS print", "'mine' AS _id", "7.0 AS spans2")
    before = {c: t for c, t in named.dtypes}
    docs = named
    for name, stage in P.STAGES[:-1]:
        after = blocks.scratch_table(spark, stage(spark, docs, SF), f"test-odd-{name}")
        assert dict(after.dtypes) == before, name
        for r in after.select("score", "removed", "spans", "items", "n_words", "root", "print", "_id").collect():
            assert set(r) == {"mine"}, name
        docs = after
    assert {r.doc_id for r in docs.collect()} >= {0, 2, 3, 4}
