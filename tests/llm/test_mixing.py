from collections import defaultdict

from issuelens.llm import mixing as M


def waterfill(sizes, weights, repeats=3):
    """Shares by weight; the excess of full sources is reshared until there is none."""
    total, target = sum(sizes), [0.0] * len(sizes)
    full = set()
    while True:
        rest = total - sum(repeats * sizes[i] for i in full)
        open_ = sum(w for i, w in enumerate(weights) if i not in full)
        target = [repeats * s if i in full else rest * w / open_ for i, (s, w) in enumerate(zip(sizes, weights))]
        new = {i for i in range(len(sizes)) if i not in full and target[i] > repeats * sizes[i]}
        if not new:
            return target
        full |= new


def rows(n):
    source = ["big", "small", "tiny", None, "Zed", "é"]
    size = [600, 8, 1, 30, 90, 40]
    out = []
    for i in range(n):
        s = i % 6
        out.append((i, " ".join(["w"] * (size[s] + i % 5)), source[s]))
    return out + [(1000, None, "big"), (1001, "", None), (1002, " ", "only empty")]


def test_targets_and_taken_words(spark):
    given = rows(240)
    df = spark.createDataFrame(given, "doc_id long, text string, source string").repartition(4)
    got = {r.doc_id: r for r in M.mix(spark, df).collect()}
    assert len(got) == len(given)
    sizes = defaultdict(int)
    for _, t, s in given:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(order, waterfill([sizes[s] for s in order], [M.WEIGHTS[i % 3] for i in range(len(order))])))
    taken = defaultdict(int)
    for i, t, s in given:
        r = got[i]
        assert (r.size, r.source_size) == (len((t or "").split()), sizes[s])
        assert abs(r.target - want[s]) < 1e-6 * (1 + want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in order:  # by less than a block
        assert 0 <= want[s] + 1e-6 - taken[s] < want[s] / M.SLOTS + 1
    again = {r.doc_id: r.taken for r in M.mix(spark, df.repartition(7)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_targets_are_met_at_every_block_size(spark):
    # a few slots a source: blocks longer than documents, as in a large corpus
    size = {"a": 300, "b": 20, "c": 7, "d": 40, "e": 3}
    given = [(i, " ".join(["w"] * size["abcde"[i % 5]]), "abcde"[i % 5]) for i in range(1000)]
    given += [(2000, "only three words", "lone")]
    df = spark.createDataFrame(given, "doc_id long, text string, source string")
    for slots in (7, 64, M.SLOTS):
        rows = M.mix(spark, df, slots=slots).collect()
        assert sorted(r.doc_id for r in rows) == sorted(i for i, _, _ in given)
        taken = defaultdict(int)
        for r in rows:
            taken[r.source] += r.taken
            assert 0 <= r.taken <= 3 * r.size
        for r in rows:
            assert 0 <= r.target + 1e-6 - taken[r.source] < r.target / slots + 1
        assert taken["lone"] == 9


SOURCES = "source string, _src long, source_size long, target double"


def test_targets_are_met_in_a_corpus_of_any_size(spark):
    # sizes of 1e3 to 1e11 words: only the schedule of them, not their texts
    sizes = [10 ** (3 + k % 9) + 17 * k for k in range(20)]
    want = waterfill(sizes, [M.WEIGHTS[i % 3] for i in range(20)])
    src = M.blocked(spark.createDataFrame([(f"s{i:02}", i + 1, n, float(t)) for i, (n, t) in enumerate(zip(sizes, want))], SOURCES))
    slots = M.schedule(spark, src)
    read = {r._src: r.before for r in M.scheduled_blocks(src, slots).join(
        src.selectExpr("_src", "blocks AS block_no"), ["_src", "block_no"]).collect()}
    for i, t in enumerate(want):
        assert 0 <= t + 1e-3 - read[i + 1] < t / M.SLOTS + 1.01


def test_schedule_is_even_and_exact(spark):
    src = M.blocked(spark.createDataFrame([("a", 1, 6400, 5000.0), ("b", 2, 1600, 3000.0), ("c", 3, 0, 0.0)], SOURCES), 500)
    planned = {r._src: r for r in src.collect()}
    assert (planned[1].block, planned[1].slots) == (10, 500) and (planned[2].block, planned[2].slots) == (6, 500)
    assert planned[3].slots == 0
    slots = M.schedule(spark, src).orderBy("slot").collect()
    assert len(slots) == 1000
    seen = {1: 0, 2: 0}
    for n, s in enumerate(slots, 1):
        assert s["rank"] == seen[s["_src"]]
        assert (s["block_no"], s["round"]) == (s["rank"] % planned[s["_src"]].blocks, s["rank"] // planned[s["_src"]].blocks)
        seen[s["_src"]] += 1
        assert abs(seen[1] - 0.5 * n) < 6
    assert seen == {1: 500, 2: 500}
    assert {s["round"] for s in slots if s["_src"] == 2} == {0, 1}


def test_odd_rows(spark, odd, none):
    out = M.mix(spark, odd).collect()
    assert sorted(((r.doc_id, r["size"]) for r in out), key=str) == sorted(
        [(0, 16), (1, 16), (2, 0), (3, 0), (4, 0), (5, 60_000), (5, 60_000), (None, 16), (None, 0), (6, 2), (7, 40)], key=str)
    assert all(r.taken <= 3 * r["size"] for r in out)
    assert M.mix(spark, none).count() == 0
