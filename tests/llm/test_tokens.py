import re

import numpy as np
import pyarrow as pa

from issuelens.llm import blocks as B
from issuelens.llm import tokens as K


def spell(w):
    return [w.data[a:z].tobytes() for a, z in zip(w.start, w.end)]


def test_words_are_those_of_the_two_classes(texts):
    data, off = K.buffers(pa.array([*texts, "A\x00b-1É_é"]))
    w = K.words(data, off)
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in [*texts, "A\x00b-1É_é"]]
    assert spell(w) == [x for d in want for x in d]
    assert w.counts.tolist() == [len(d) for d in want]
    w = K.words(data, off, K.ALNUM, lower=True)
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in [*texts, "A\x00b-1É_é"]]
    assert [x.decode() for x in spell(w)] == [x for t in lower for x in re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)]


def test_hashes_tell_words_and_windows_apart():
    texts = ["a b ab", "a" * 600 + " " + "a" * 599 + "b", "ab a b"]
    w = K.words(*K.buffers(pa.array(texts)))
    by = {}
    for s, h in zip(spell(w), w.hash.tolist()):
        assert by.setdefault(s, h) == h
    assert len(set(by.values())) == len(by) == 5
    at, h = K.windows(w, 2)
    assert at.tolist() == [0, 1, 3, 5, 6] and len(set(h.tolist())) == 4 and h[0] == h[4]


def test_slices_cover_every_document():
    off = np.array([0, 5, 5, 100, 101, 300])
    assert list(K.slices(off, 10)) == [(0, 2), (2, 3), (3, 4), (4, 5)]


def test_packing_round_trips():
    for a in (np.arange(0, 10 ** 6, 7, dtype=np.uint64) << np.uint64(20), np.zeros(0, np.uint64), np.array([1.5, -2.0, 1.5])):
        assert np.array_equal(B.unpack(B.pack(a), a.dtype), a)
        assert np.array_equal(B.unpack_coded(B.pack_coded(a), a.dtype), a)


def test_blocks_hold_every_row_in_order(spark, odd):
    blocks = B.write_blocks(spark, odd.select("doc_id", "text").coalesce(1), "text", "t")
    rows = [r for b in blocks.orderBy("_block").collect() for r in B.decode(bytes(b["_data"])).to_pylist()]
    assert [(r["doc_id"], r["text"]) for r in rows] == [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
