import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from issuelens.llm import langid as M
from issuelens.llm import tokens as K

SF = "/root/testdata/sf0.01"


def test_ngrams_are_those_of_each_word():
    words = ["the", "é", "über", "the", "a"]
    w, place, kind = M._distinct_words(*K.buffers(pa.array([" ".join(words), ""])))
    spelled = [w.data[w.start[i]:w.end[i]].tobytes().decode() for i in place]
    for n in range(1, 6):
        h, of = M.ngrams(w, place, n)
        by = {}
        for x, k in zip(h.tolist(), of.tolist()):
            by.setdefault(spelled[k], []).append(x)
        for s in spelled:
            padded = f" {s} " if n > 1 else s
            want = [padded[i:i + n] for i in range(len(padded) - n + 1)]
            assert len(by.get(s, [])) == len(want) and len(set(by.get(s, []))) == len(set(want))
    assert kind.max() == 3


def test_unseen_words_back_off():
    data = K.buffers(pa.array(["known knows"]))
    w, place, _ = M._distinct_words(*data)
    known = w.hash[:1]
    grams, _ = M.ngrams(w, np.array([1]), 2)
    key = np.unique(grams)[:1]
    tables = [(known, np.array([[-1.0, -2.0]]))] + [(np.zeros(0, np.uint64), np.zeros((0, 2)))] * M.LONGEST
    tables[2] = (key, np.array([[-7.0, -3.0]]))
    scores = M.Model(["x", "y"], tables).word_scores(w, np.array([0, 1]))
    assert scores.tolist() == [[-1.0, -2.0], [-7.0, -3.0]]


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = M.query(spark, SF).join(truth, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_rare_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(M, "TRAIN_DOCS", 60)
    monkeypatch.setattr(M, "KEYS", 60)
    rows = [(i, " ".join(f"{a}{b}" for a in "bcdfg" for b in "aeiou") + f" {'klm'[i % 3]}{'uvw'[i % 2]}a", "en") for i in range(3000)]
    rows += [(5000 + i, "žluť kůň úpěl ďábel", "cs") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = M.train(spark, df)
    assert model.languages == ["cs", "en"]
    assert all(r.lang == r.lang_pred for r in M.identify(spark, df, model).collect())
    assert M._even({"a": 5, "b": 100, "c": 40}, 60) == 27.5 and M._even({"a": 5, "b": 7}, 60) == 7


def test_odd_rows(spark, odd, none):
    model = M.train(spark, odd)
    rows = M.identify(spark, odd, model).collect()
    assert sorted({(r.doc_id if r.doc_id is not None else -1, r.lang_pred) for r in rows if r.doc_id != 5}) == [
        (-1, "en"), (-1, "und"), (0, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "und"), (6, "en"), (7, "en")]
    assert {r.score for r in rows if r.lang_pred == "und"} == {0.0}
    nothing = M.train(spark, none)
    assert {r.lang_pred for r in M.identify(spark, odd, nothing).collect()} == {"und"}
    assert M.identify(spark, none, model).count() == 0


def spelled(text):
    lower = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
    return re.findall("[a-z\u0080-\U0010ffff]+", lower)


def grams(word, n):
    padded = f" {word} " if n > 1 else word
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def brute(docs):
    """(held_out, language, posterior) per doc_id, with plain dictionaries."""
    held = {i: zlib.crc32(str(i).encode()) % M.FOLDS == 0 for i, _, _ in docs}
    counts = [defaultdict(Counter) for _ in range(M.LONGEST + 1)]
    for i, text, lang in docs:
        if not held[i] and lang is not None:
            for word in spelled(text):
                counts[0][lang][word] += 1
                for n in range(1, M.LONGEST + 1):
                    counts[n][lang].update(grams(word, n))
    languages = sorted({x for _, _, x in docs if x is not None})
    keys = [set().union(*c.values()) for c in counts]
    assert max(map(len, keys)) <= M.KEYS  # nothing is cut off here
    total = [{x: sum(c[x].values()) for x in languages} for c in counts]

    def log(size, key, lang):
        return math.log((counts[size][lang][key] + M.SMOOTHING) / (total[size][lang] + M.SMOOTHING * (len(keys[size]) + 1)))

    def score(word, lang):
        if word in keys[0]:
            return log(0, word, lang)
        for n in range(M.LONGEST, 0, -1):
            if known := [g for g in grams(word, n) if g in keys[n]]:
                return sum(log(n, g, lang) for g in known) / len(known)
        return 0.0

    out = {}
    for i, text, _ in docs:
        words = Counter(spelled(text))
        if not any(c.isalpha() for c in text or ""):
            out[i] = (held[i], "und", 0.0)
            continue
        sums = [sum(n * score(w, x) for w, n in words.items()) for x in languages]
        best = max(range(len(languages)), key=lambda k: sums[k])
        out[i] = (held[i], languages[best], 1 / sum(math.exp(x - sums[best]) for x in sums))
    return out


def test_the_query_equals_brute_force(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").limit(120).collect()
    docs = [(r.doc_id, r.text, r.lang) for r in given]
    docs += [(900_000, None, "en"), (900_001, "12 34", "de"), (900_002, "zzzqqq", None), (900_003, "The Café!", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(docs)
    got = M.query(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    for r in got:
        held, lang, score = want[r.doc_id]
        assert (r.held_out, r.lang_pred) == (held, lang) and abs(r.score - score) < 1e-3
