import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from issuelens.llm import katz as M

END, BEGIN = "</doc>", "<doc>"


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [END]


class Direct:
    """Katz backoff over plain counters."""

    def __init__(self, docs, order):
        self.order, self.count = order, [Counter() for _ in range(order + 1)]
        for t in docs:
            for k in range(1, order + 1):
                padded = [BEGIN] * (k - 1) + t
                self.count[k].update(tuple(padded[i:i + k]) for i in range(len(t)))
        of = [Counter(c.values()) for c in self.count]
        self.d = [M.discounts([n[r] for r in range(1, M.CUT + 2)]) for n in of]
        self.total = sum(self.count[1].values())
        self.after = [defaultdict(dict) for _ in range(order + 1)]
        for k in range(1, order + 1):
            for g, c in self.count[k].items():
                self.after[k][g[:-1]][g[-1]] = c

    def p(self, context, w):
        k = len(context) + 1
        if k == 1 and not self.total:
            return 1.0
        seen = self.after[k].get(context)
        if not seen:
            return self.p(context[1:], w)
        n = sum(seen.values())
        low = sum((1 - self.d[k][c]) * c for c in seen.values() if c <= M.CUT)
        if w in seen:
            return (self.d[k][min(seen[w], M.CUT + 1)] if low else n / (n + 1)) * seen[w] / n
        left = low / n if low else 1 / (n + 1)
        if k == 1:
            return left
        return left / (1 - sum(self.p(context[1:], x) for x in seen)) * self.p(context[1:], w)

    def score(self, t):
        padded = [BEGIN] * (self.order - 1) + t
        return sum(math.log10(self.p(tuple(padded[i:i + self.order - 1]), w)) for i, w in enumerate(t))


@pytest.mark.parametrize("order, hot, block", [(2, 200_000, 8 << 20), (2, 5, 3000), (3, 20, 5000), (1, 5, 3000)])
def test_scores_equal_direct_computation(spark, docs, texts, monkeypatch, order, hot, block):
    monkeypatch.setattr(M, "HOT", hot)
    monkeypatch.setattr(M.B.pack_blocks, "__defaults__", (block,))
    monkeypatch.setattr(M.B.n_buckets, "__defaults__", (6, 2_000_000 if block > 10_000 else 500))
    all_ = [tokens(t) for t in texts]
    train = [t for i, t in enumerate(all_) if i % 3]
    direct = Direct(train, order)
    total, kinds = direct.total, len(direct.count[1])
    rows = M.score(spark, docs, F.col("doc_id") % 3 != 0, order=order).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = all_[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum((w,) in direct.count[1] for w in t), total)
        base = sum(math.log10((direct.count[1][(w,)] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, direct.score(t), rel_tol=1e-9)


def test_contexts_sum_to_one():
    words = "a b a c a b d a a e f a b".split() + [END]
    direct = Direct([words, ["g", "a", END], [END]], 2)
    vocabulary = [*{w for (w,) in direct.count[1]}, "<unknown>"]
    for context in [(BEGIN,), ("a",), ("g",), ("never",)]:
        assert math.isclose(sum(direct.p(context, w) for w in vocabulary), 1)


def test_discounts_stay_proper():
    assert M.discounts([0] * 6).tolist() == [0, *[(r - 0.5) / r for r in range(1, 6)], 1]
    d = M.discounts([1000, 400, 220, 140, 100, 75])
    assert (d[1:6] > 0).all() and (d[1:6] < 1).all() and np.all(np.diff(d) > 0)


def test_odd_rows(spark, odd, none):
    rows = M.score(spark, odd, F.col("doc_id") < 6).collect()
    got = sorted(((r.doc_id, r.n_tokens) for r in rows), key=str)
    assert got == sorted([(0, 17), (1, 17), (2, 1), (3, 1), (4, 1), (5, 60_001), (5, 60_001), (None, 17), (None, 1),
                          (6, 3), (7, 41)], key=str)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in rows)
    assert M.score(spark, none, F.lit(True)).count() == 0
    assert {r.score for r in M.score(spark, odd, F.lit(False)).collect()} == {0.0}
