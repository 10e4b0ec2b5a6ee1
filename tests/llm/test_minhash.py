import itertools
import random
import re

from issuelens.llm import components as C
from issuelens.llm import minhash as M


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        k = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def variants(n, length, edits, seed):
    r = random.Random(seed)
    base = [f"b{seed}x{i}" for i in range(length)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randint(0, edits)):
            words[r.randrange(length)] = f"e{r.randrange(10 ** 9)}"
        out.append(" ".join(words))
    return out


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in M.near_duplicates(spark, df).collect()}
    want = brute(texts)
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_components_equal_brute_force(spark, texts):
    groups = variants(40, 100, 7, 1) + variants(40, 400, 25, 2) + variants(20, 195, 10, 3) + variants(12, 9, 2, 4)
    check(spark, [*texts, *groups])


def test_odd_rows(spark, odd, none):
    rows = M.near_duplicates(spark, odd).collect()
    assert len(rows) == 11
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert of[0] == [(12, 0, True)] and of[1] == [(12, 0, False)]
    assert of[2] == of[3] == of[4] and of[2][0][0] == 0 or of[2][0][1:] == (2, True)
    assert [x[1:] for x in of[5]] == [(5, True)] * 2
    assert sorted(of[None], key=str) == sorted([(12, 0, False), (0, None, True)], key=str)
    assert M.near_duplicates(spark, none).count() == 0


def test_long_chains_are_one_component(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(101, 100), (100, 102), (102, 101)]
    got = dict(C.components(spark, spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 1 for i in range(2, 61)}, 101: 100, 102: 100}
    assert C.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_values_move_once_as_plain_rows(spark):
    import re

    from issuelens.llm import minhash as H

    # two classes of equal values but one, and a third that shares too few to take part
    rows = [(1, 10, 8, list(range(8)), None), (2, 20, 8, list(range(7)) + [70], None), (3, 30, 8, [0, 1] + list(range(90, 96)), None)]
    members = H._members(spark.createDataFrame(rows, "cls long, rep long, n long, small array<long>, large array<long>"))
    got = {r.cls: (r.typical, sorted(r.lists)) for r in members.collect()}
    assert got == {1: (7, [2, 3]), 2: (7, [2, 3])}
    plan = members._jdf.queryExecution().toString()
    assert not re.search(r"hashpartitioning\(cls#\d+L, tier#\d+, fewest#", plan)  # lists of partial aggregates do not move


def test_sets_move_by_tile_not_by_list_or_pair(spark, monkeypatch):
    made, table = [], M.B.scratch_table
    monkeypatch.setattr(M.B, "scratch_table", lambda s, df, name: made.append((name, t := table(s, df, name))) or t)
    monkeypatch.setattr(M.B, "forget", lambda s, *tables: None)
    monkeypatch.setattr(M, "TILE_VALUES", 500)  # many blocks
    check(spark, variants(40, 100, 9, 5) + variants(30, 300, 40, 6))
    (open_,) = (t for name, t in made if name == "open")
    assert "sketch" not in open_.columns
    assert open_.count() == open_.select("cls", "tier").distinct().count() > 0  # a row of each class, not of each list
