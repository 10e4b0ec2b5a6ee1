import random

import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=120, seed=3):
    """Invented documents with exact and near copies, shared passages, odd spaces and empty ones."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Éa", "ß", "o'k", "x,", "THE", "the"]
    passage = " ".join(r.choice(vocabulary) for _ in range(30))
    texts = []
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.1:
            texts.append(r.choice(texts))
        elif texts and kind < 0.3:
            words = (r.choice(texts) or "").split(" ")
            for _ in range(r.randint(1, 3)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            words = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 4, 5, 12, 13, 60, 250, 320]))]
            if kind > 0.85:
                words[len(words) // 2:0] = [passage]
            texts.append(r.choice([" ", "\n", " \t ", "\r\n"]).join(words))
    return texts


@pytest.fixture(scope="session")
def texts():
    return corpus() + ["", " \n ", None]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, a very long text, repeated rows and columns named like results."""
    long = " ".join(f"t{i % 9973}" for i in range(60_000))
    plain = "a b c d e f g h i j k l m n o p"
    rows = [(0, plain), (1, plain), (2, None), (3, ""), (4, " \n\t"), (5, long), (5, long), (None, plain), (None, None),
            (6, "one two"), (7, "ünï " * 40)]
    named = ["n_words", "n_removed", "kept", "kept_sha256", "removed", "items", "spans", "n_hit", "score", "size", "taken",
             "target", "source_size", "cls", "component_id", "lang_pred", "_size", "id"]
    df = spark.createDataFrame([(i, t, None if i == 2 else "en", None if i == 3 else "s", 0) for i, t in rows], DOCUMENTS)
    return df.select("*", *(F.lit("mine").alias(c) for c in named))


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
