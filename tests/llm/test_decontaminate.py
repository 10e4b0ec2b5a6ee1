import random
import re

from issuelens.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items):
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for name, item in items:
            v = words(item)
            n = min(len(v), 10)
            for j in range(len(v) - n + 1) if n else ():
                for i in range(len(w) - n + 1):
                    if w[i:i + n] == v[j:j + n]:
                        hit.update(range(i, i + n))
                        found.add(str(name))
        out.append((len(w), len(hit), sorted(found)))
    return out


def cases():
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("ab bc Cd d-e é f g".split()) for _ in range(n))
    items = [(i, text(r.choice([3, 6, 9, 10, 11, 25]))) for i in range(25)] + [(3, text(12)), (30, ""), (31, None), (32, "zz")]
    texts = [text(r.choice([0, 4, 40, 120])) for _ in range(40)]
    for k in range(15):
        _, item = r.choice(items[:25])
        texts[k] += " " + item.upper() + "; " + text(5)
    return [*texts, None, "", "x zz", "zz"], items


def test_hits_equal_brute_force(spark, monkeypatch):
    texts, items = cases()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items)
    for limit in (1 << 20, 300):  # one automaton, and several
        monkeypatch.setattr(D, "BLOCK_BYTES", limit)
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in D.find_contamination(spark, docs, bench).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert D.item_blocks(bench, "item_id", "text")[1] > 1


def test_clean_cuts_spans_and_rejects_what_is_mostly_hit(spark):
    item = " ".join(f"q{i}" for i in range(12))
    texts = [f"Start here. {item}! Then we go on " + "and on " * 20, item, "nothing of it", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in D.clean(spark, docs, items).collect()}
    assert got == {0: "Start here. Then we go on " + "and on " * 20, 2: "nothing of it", 3: None}


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(None, "c d e f g h i j k l"), (1, "one two"), (1, "one two")], "item_id long, text string")
    rows = D.find_contamination(spark, odd, bench).collect()
    got = {(r.doc_id, r.n_words): (r.n_hit, r["items"]) for r in rows}
    assert len(rows) == 11 and got[0, 16] == (10, []) and got[6, 2] == (2, ["1"]) and got[None, 0] == (0, [])
    assert got[5, 60_000] == (0, [])
    assert D.find_contamination(spark, none, bench).count() == 0
    assert {r.n_hit for r in D.find_contamination(spark, odd, bench.limit(0)).collect()} == {0}


def test_each_call_scans_with_its_own_items(spark):
    docs = spark.createDataFrame([(0, "aa bb"), (1, "cc dd"), (2, "ee ff")], "doc_id long, text string").repartition(1)
    for k in range(12):  # equal shapes: reused workers must not meet an earlier automaton
        text = ("aa bb", "cc dd", "ee ff")[k % 3]
        bench = spark.createDataFrame([(1, text)], "item_id long, text string")
        got = {r.doc_id: r.n_hit for r in D.find_contamination(spark, docs, bench).collect()}
        assert got == {i: 2 * (i == k % 3) for i in range(3)}
