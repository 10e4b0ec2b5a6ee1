import pytest


from issuelens.functions.vector import hash_embed, hash_embed_native, l2_normalize, squared_l2
from issuelens.operators.embed import ModelEmbedder, check_model, embed
from tests import pyref


def length_model():
    calls = []

    def model(texts):
        calls.append(len(texts))
        assert len(texts) <= 3  # batch size respected
        return [[float(len(t)), 1.0] for t in texts]

    return model


def test_model_embedder_batches_and_caps(spark):
    df = spark.createDataFrame([(i, "x" * (i * 10)) for i in range(7)], "id bigint, text string")
    out = embed(df, ModelEmbedder(length_model, "len-model", batch_size=3), "text", max_chars=25)
    got = {r.id: (list(r.embedding), r.embed_model) for r in out.collect()}
    assert got[6] == ([25.0, 1.0], "len-model") and got[1] == ([10.0, 1.0], "len-model")
    assert out.where(check_model(out, ModelEmbedder(length_model, "other"))).count() == 0


def test_empty_embedding_fails(spark):
    def empty_model():
        return lambda texts: [[] for _ in texts]

    df = spark.createDataFrame([(1, "a")], "id bigint, text string")
    with pytest.raises(Exception):
        embed(df, ModelEmbedder(empty_model, "empty"), "text").collect()


def test_hash_embed_forms_agree_with_python(spark):
    texts = ["Émile a écrit 12 lignes", "", None, "naïve naïve NAÏVE", "x" * 3000, "ß straße 🙂 mañana"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(hash_embed("t", 16).alias("a"), hash_embed_native("t", 16).alias("b")).collect()
    for t, r in zip(texts, rows):
        want = pyref.hash_vec(t, 16)
        assert all(abs(x - y) < 1e-12 for x, y in zip(r.a, want))
        assert all(abs(x - y) < 1e-12 for x, y in zip(r.b, want))


def test_pair_distance_and_normalize(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0], [0.0, 0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(squared_l2("a", "b").alias("d"), l2_normalize("a").alias("n")).first()
    assert r.d == 9.0 and [round(x, 12) for x in r.n] == [round(x / 3, 12) for x in (1.0, 2.0, 2.0)]


def test_tokens_that_a_worker_keeps_are_bounded():
    import sys

    from issuelens.functions import vector as V

    text = " ".join([f"word{i}" for i in range(150_000)] + ["y" * 500 + str(i) for i in range(100)])
    got = V._embed_batch([text], 64)[0]
    want = pyref.hash_vec(text, 64)
    assert max(abs(x - y) for x, y in zip(got, want)) < 1e-12
    assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in V._HASHES.items()) + sys.getsizeof(V._HASHES) < 8 << 20
    assert max(map(len, V._HASHES)) <= 100


def test_vectors_keep_their_rows_over_slices(spark):
    texts = [None if i % 97 == 0 else f"text {i} of {i % 5}" for i in range(1300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    for r in df.select("i", hash_embed("t", 16).alias("v")).collect():
        want = pyref.hash_vec(texts[r.i], 16)
        assert len(r.v) == 16 and all(abs(x - y) < 1e-12 for x, y in zip(r.v, want))
