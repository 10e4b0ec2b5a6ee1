"""Vector column functions.

``hash_embed`` is the offline embedder used for tests and for runs without
a model server: lower-case, split into letter/digit runs, hash each token
into one of ``dim`` buckets, count, L2-normalise.  It is built from native
functions only (no Python in the task), and the bucket hash is the first
32 bits of ``md5`` so the same vectors can be recomputed in plain SQL.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from issuelens.functions.memory import give_back
from issuelens.functions.text import col_

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: Column | str) -> Column:
    """Lower-cased letter/digit runs; empty pieces removed."""
    parts = F.split(F.lower(F.coalesce(col_(text), F.lit(""))), TOKEN_SPLIT)
    return F.filter(parts, lambda t: F.length(t) > 0)


def token_bucket(tok: Column, dim: int) -> Column:
    h = F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(dim))


def _normalized(acc: Column) -> Column:
    """``acc / |acc|`` for a bound array variable (all zeros stay zeros)."""
    norm = F.sqrt(F.aggregate(acc, F.lit(0.0), lambda s, y: s + y * y))
    return F.transform(acc, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def hash_embed_native(text: Column | str, dim: int = 64) -> Column:
    """Native-function form of ``hash_embed`` (same vectors).

    One ``aggregate`` pass: the token/bucket array is its input and is
    evaluated once per row.  Higher-order functions are interpreted per
    row, so this form is ~25x slower than the Arrow-batched one below; it
    is kept as an executable definition the tests compare against.
    """
    buckets = F.transform(tokens(text), lambda t: token_bucket(t, dim))
    zero = F.array_repeat(F.lit(0.0), dim)
    return F.aggregate(
        buckets, zero,
        lambda acc, b: F.transform(acc, lambda x, i: F.when(i == b, x + 1.0).otherwise(x)),
        _normalized,
    )


# Letter/number runs: Python's [^\W_] is exactly str.isalnum(), i.e. the
# Unicode L and N categories of TOKEN_SPLIT's complement.
_TOKEN_RE = None

#: Texts that a task has as Python strings at once.
SLICE = 512


class _Hashes(dict):
    """token -> 32-bit hash, per Python worker; bounded by tokens and their length, cleared when full.

    Every worker of an executor holds one, so a vocabulary that grows with the
    texts must not: 32,768 tokens of at most 32 characters are 6 MB.
    """

    LIMIT = 1 << 15
    LONGEST = 32

    def __missing__(self, token: str) -> int:
        h = int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16)
        if len(token) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[token] = h
        return h


_HASHES = _Hashes()


def _embed_batch(texts, dim: int):
    global _TOKEN_RE
    if _TOKEN_RE is None:
        _TOKEN_RE = re.compile(r"[^\W_]+")
    out = []
    for s in texts:
        found = _TOKEN_RE.findall(s.lower()) if s is not None else []
        hashes = np.fromiter(map(_HASHES.__getitem__, found), np.int64, len(found))
        v = np.bincount(hashes % dim, minlength=dim).astype(float)
        n = float(np.sqrt((v * v).sum()))
        out.append(v / n if n > 0 else v)
    return out


def hash_embed(text: Column | str, dim: int = 64) -> Column:
    """Dense ``array<double>`` of length ``dim``; all zeros for no tokens.

    Arrow UDF: tokenising and md5-bucketing in Python is far cheaper than
    interpreted higher-order functions, and the embedder is the model slot of
    the pipeline anyway (batch inference).  Of an Arrow batch only ``SLICE``
    texts at a time become Python strings, and their vectors stay flat.
    """
    @F.arrow_udf("array<double>")
    def _hash_embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            flat = np.empty((len(texts), dim))
            for lo in range(0, len(texts), SLICE):
                part = texts.slice(lo, SLICE)
                flat[lo:lo + len(part)] = _embed_batch(part.to_pylist(), dim)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(flat.ravel()))
        give_back()

    return _hash_embed(col_(text))


def l2_normalize(vec: Column | str) -> Column:
    """Unit-length copy of a numeric array (evaluates its input once)."""
    zero = F.struct(F.array().cast("array<double>").alias("a"), F.lit(0.0).alias("s"))
    return F.aggregate(
        col_(vec), zero,
        lambda acc, x: F.struct(
            F.concat(acc.getField("a"), F.array(x.cast("double"))).alias("a"),
            (acc.getField("s") + x.cast("double") * x.cast("double")).alias("s")),
        lambda acc: F.transform(acc.getField("a"), lambda x: F.when(
            acc.getField("s") > 0, x / F.sqrt(acc.getField("s"))).otherwise(F.lit(0.0))),
    )


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance of two equal-length arrays, in double.

    Used for single pairs (tests, audits); collection-wide search goes
    through the block kernel in ``operators.search``.
    """
    diffs = F.zip_with(col_(a), col_(b), lambda x, y: (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, d: acc + d * d)
