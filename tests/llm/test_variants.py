import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from issuelens.llm import variants as V


def counted(rows, typo=V.TYPO):
    """Words of (doc_id, text), with the missing code points."""
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % typo == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= V.MIN_LENGTH and n >= V.MIN_COUNT}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(words):
    near = defaultdict(list)
    for a in words:
        for b in words:
            if one_edit(a, b):
                near[a].append(b)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 2 * n:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def invented(seed, n, alphabet="abé", lengths=(1, 2, 3, 5, 6, 7, 8)):
    r = random.Random(seed)
    words = {"".join(r.choice(alphabet) for _ in range(r.choice(lengths))): r.randint(1, 60) for _ in range(n)}
    long = "".join(r.choice(alphabet) for _ in range(400))
    return words | {long: 50, long[:200] + "z" + long[200:]: 8, long[1:]: 3}


@pytest.mark.parametrize("tile", [1024, 64, 16])
def test_every_pair_one_edit_apart(spark, monkeypatch, tile):
    # few letters: large groups, many ways to place an edit, repeated letters
    monkeypatch.setattr(V, "TILE", tile)
    words = invented(tile, 350)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got(V.variants(spark, df)) == sorted(grouped(words), key=lambda r: r[0])


@pytest.mark.parametrize("cells", [50, 5000])
def test_slices_of_code_points(cells, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(V, "CELLS", cells)
    words = sorted(w for w in invented(5, 200) if len(w) in (7, 8))
    row, piece = np.zeros(len(words), int), np.array([0])
    pairs = [p for k in range(V.PIECES) for a, b in V.near_pairs(pa.array(words), np.array([7]), piece + k, row, row)
             for p in zip(a.tolist(), b.tolist())]
    want = {frozenset((a, b)) for a in words for b in words if one_edit(a, b) and min(len(a), len(b)) == 7}
    assert len(pairs) == len(want) and {frozenset((words[a], words[b])) for a, b in pairs} == want


def test_words_of_documents(spark):
    r = random.Random(2)
    base = ["maison", "Maisons", "forêt", "FORÊT", "strasse", "straße", "niño", "niñas", "ninas", "über", "überall", "x"]
    rows = [(i, ". ".join(r.choice(base) for _ in range(40))) for i in range(60)] + [(None, "maison maison"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words = counted(rows, 7)
    assert len(words) > 15
    assert {(x.word, x.n) for x in V.count_words(df, typo=7).collect()} == set(words.items())
    assert got(V.variants(spark, V.count_words(df, typo=7))) == sorted(grouped(words), key=lambda x: x[0])


def test_the_query_on_a_small_table(spark, texts, tmp_path):
    rows = [(i, (t or "") + " Receive receive recieve receives receiv") for i, t in enumerate(texts)] + [(900, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert got(V.query(spark, str(tmp_path))) == sorted(grouped(counted(rows)), key=lambda x: x[0])


def test_chains_lead_to_their_root(spark):
    chain = ["aaaaaaa" + "b" * i for i in range(12)]
    words = {w: 3 * 2 ** i for i, w in enumerate(chain)}
    rows = V.variants(spark, spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {r.root for r in rows} == {chain[-1]}
    assert {r.word: r.form for r in rows} == dict(zip(chain, chain[1:] + [None]))


def test_no_join_collects_a_table_on_the_driver(spark, monkeypatch):
    # tables this small are broadcast wherever the plan leaves that to Spark
    plans, write = {}, V.B.scratch_table

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def seen(spark, df, name):
        plans.setdefault(name, []).append(plan(df))
        return write(spark, df, name)

    monkeypatch.setattr(V.B, "scratch_table", seen)
    words = invented(3, 200)
    df = V.variants(spark, spark.createDataFrame(list(words.items()), "word string, n long"))
    assert got(df) == sorted(grouped(words), key=lambda r: r[0])
    plans["result"] = [plan(df)]
    assert not [name for name, found in plans.items() for p in found if "Broadcast" in p]
    assert {name for name, found in plans.items() if any("SortMergeJoin" in p for p in found)} == {
        "variant-blocks", "variant-roots", "result"}


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    named = odd.selectExpr("*", "'mine' AS word", "'mine' AS n", "'mine' AS g", "'mine' AS run")
    assert set(V.count_words(named, typo=5, min_length=1).collect()) == set(V.count_words(odd, typo=5, min_length=1).collect())
    assert got(V.variants(spark, V.count_words(odd))) == sorted(grouped(counted(rows)), key=lambda x: x[0])
    assert V.variants(spark, V.count_words(none)).count() == 0
    df = spark.createDataFrame([(None, 4), ("abcde", None), ("abcde", 2), ("abcde", 2), ("abcdx", 9)], "word string, n long")
    assert got(V.variants(spark, df)) == [("abcde", "abcdx", "abcdx", 4, 1, 9), ("abcdx", None, "abcdx", 9, 1, None)]
