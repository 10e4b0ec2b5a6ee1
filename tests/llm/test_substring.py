import hashlib
import re

from issuelens.llm import substring_dedup as S


def brute(rows, size=13):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, split):
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            first[key] = min(first.get(key, i), i)
    out = {}
    for (i, _), w in zip(rows, split):
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < i:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_removals_equal_brute_force(spark, docs, texts, monkeypatch):
    want = brute(list(enumerate(texts)))
    for block, keys in ((8 << 20, 2_000_000), (2000, 100)):  # one block and bucket, and many
        monkeypatch.setattr(S.B, "BUCKET_KEYS", keys)
        monkeypatch.setattr(S.B.pack_blocks, "__defaults__", (block,))
        monkeypatch.setattr(S.B.n_buckets, "__defaults__", (6, keys))
        rows = S.substring_dedup(spark, docs).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want
        for r in rows:
            assert r.n_removed == sum(e - s for s, e in r.removed)
            assert hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")).encode()).hexdigest() == r.kept_sha256


def test_odd_rows(spark, odd, none):
    rows = S.substring_dedup(spark, odd).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in rows), key=str)
    assert got == sorted([(0, 16, 0), (1, 16, 16), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 60_000, 0), (5, 60_000, 0),
                          (None, 16, 16), (None, 0, 0), (6, 2, 0), (7, 40, 0)], key=str)
    assert {r.size for r in rows} == {"mine"}
    assert S.substring_dedup(spark, none).count() == 0
