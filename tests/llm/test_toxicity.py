import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from issuelens.llm import tokens as K
from issuelens.llm import toxicity as M

SF = "/root/testdata/sf0.1"


def test_composition_runs_the_machines_in_turn():
    negation, report, aim = (M.build(s, a) for s, a in ((M._negation, M._ALPHABET), (M._report, M._MID), (M._aim, M._MID)))
    for seq in itertools.product(range(6), repeat=4):
        assert M.GRAMMAR.run(seq) == aim.run(report.run(negation.run(seq)))


def test_tags():
    N, I, T, G, R, X = M.NEGATION, M.INSULT, M.TARGET, M.AIMED, M.REPORT, M.NONE
    assert M.tag([X, I]) == [X, I]
    assert M.tag([N, X, I]) == [N, X, I | M.NEGATED]
    assert M.tag([N, X, X, X, I]) == [N, X, X, X, I]
    assert M.tag([R, X, T, I]) == [R, X, T, I | M.REPORTED | G]
    assert M.tag([M.THREAT, T]) == [M.THREAT | G, T]


def features(text):
    import pyarrow as pa
    return M.clause_features(M._tokens(*K.buffers(pa.array([text]))), M.Lexicon([])).tolist()[0]


def test_clauses_and_not_words_are_scored():
    assert features("you are an idiot") == [0, 0, 0, M.LISTED, 0, 0]
    assert features("you are not an idiot") == [0, M.LISTED, 0, 0, 0, 0]
    assert features("she said: what an idiot") == [M.LISTED, 0, 0, 0, 0, 0]
    assert features("he said what an idiot") == [0, 0, M.LISTED, 0, 0, 0]
    assert features("I will kill you") == [0, 0, 0, 0, M.LISTED, 0]
    assert features("kill the process. you wait") == [0, 0, 0, 0, 0, M.LISTED]
    assert features("calm words") == [0] * 6


def test_held_out_accuracy_and_ranges(spark):
    scored = M.query(spark, SF)
    truth = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scored.join(truth, "doc_id").where("held_out").collect()
    toxic = [r.score for r in rows if r.toxic == 1]
    clean = [r.score for r in rows if r.toxic == 0]
    auc = sum((t > c) + 0.5 * (t == c) for t in toxic for c in clean) / (len(toxic) * len(clean))
    assert auc > 0.9 and sum(r.predicted == r.toxic for r in rows) > 0.95 * len(rows)
    assert scored.where("score < 0 or score > 1 or score is null or predicted <> int(score >= 0.5)").count() == 0


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (1, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    model = M.train(odd, labels)
    rows = M.score_documents(spark, odd, model).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows) and {r.taken for r in rows} == {"mine"}
    empty = M.train(odd, labels.limit(0))
    assert {round(r.score, 3) for r in M.score_documents(spark, odd, empty).collect()} == {0.5}
    assert M.score_documents(spark, none, model).count() == 0
    assert M.train(none, labels).beta[0] == 0


def test_fold_is_crc32_of_the_id(spark):
    import zlib
    got = spark.range(50).select("id", M.fold_of("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)
    assert spark.range(1).select(M.fold_of("id", 5) == F.lit(0)).count() == 1


def learned_words(rows):
    """Weights of the words that toxic texts of (text, label) have more often, by the evidence for it."""
    n_t = sum(1 for _, y in rows if y)
    n_c = len(rows) - n_t
    t, c = Counter(), Counter()
    for text, y in rows:
        (t if y else c).update(set(re.findall(WORD, lower(text))))
    out = {}
    for word in t:
        a, b, n = t[word], c[word], n_t + n_c
        cells = [(a, (a + b) * n_t), (b, (a + b) * n_c), (n_t - a, (n - a - b) * n_t), (n_c - b, (n - a - b) * n_c)]
        evidence = 2 * sum(k * math.log(k * n / m) for k, m in cells if k)
        weight = math.log((a + 0.5) / (n_t + 1)) - math.log((b + 0.5) / (n_c + 1))
        if a >= 3 and weight > 0 and evidence >= M.EVIDENCE:
            out[word] = weight
    return out


WORD = "[a-z0-9'\u0080-\U0010ffff]+"


def lower(text):
    return "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")


def matched(text, insults):
    """Sums of matched words by how their clause uses them, read off the rules instead of the machines."""
    out = [0.0] * M.FEATURES
    for clause in re.split(r"[.;:!?\n]", lower(text)):
        words = re.findall(WORD, clause)

        def kind(w):
            if w in insults or w in M.INSULTS:
                return "insult"
            return next((k for k, listed in (("threat", M.THREATS), ("target", M.TARGETS), ("no", M.NEGATIONS),
                                             ("report", M.REPORTS)) if w in listed), None)

        kinds = [kind(w) for w in words]
        for i, (w, k) in enumerate(zip(words, kinds)):
            if k not in ("insult", "threat"):
                continue
            negated = "no" in kinds[max(i - M.SCOPE, 0):i]
            reported = "report" in kinds[:i]
            aimed = "target" in kinds
            if k == "threat":
                f = 4 if aimed and not negated and not reported else 5
            else:
                f = 2 if reported else 1 if negated else 3 if aimed else 0
            out[f] += insults.get(w, M.LISTED)
    return out


def test_the_query_equals_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    texts |= {10 ** 6: None, 10 ** 6 + 1: "He said you are an idiot. I don't hate it, you moron; we'll kill you!"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % M.FOLDS == 0
    rows = [(texts[i], y) for i, y in labels if i in texts and y is not None and not held(i)]
    insults = learned_words(rows)
    assert len(insults) > 3
    beta = M.fit(np.array([matched(t, insults) for t, _ in rows]), np.array([y > 0 for _, y in rows], float))
    got = {r.doc_id: r for r in M.query(spark, str(tmp_path)).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        x = np.array([matched(t, insults)])
        z = np.concatenate([[1.0], np.log1p(x[0]), [np.log1p(x.sum())]]) @ beta
        score = 1 / (1 + math.exp(-z))
        assert got[i].held_out == held(i) and abs(got[i].score - score) < 1e-6 and got[i].predicted == (got[i].score >= 0.5)
