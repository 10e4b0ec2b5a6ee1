"""Spelling variants: words one insertion, deletion or replacement apart, by dense prefix-suffix tiles.

Two words are near if their common prefix and their common suffix together
reach the longer word's length minus one.  A tile takes two blocks of words as
padded matrices of code points, one read from the front and one from the back,
and compares all their rows at once.

Which blocks meet: with m the length of the shorter word, positions are cut
into PIECES pieces.  A single edit falls into one piece, so near words agree in
all others; each word joins, for its own length as m and for one less, the
group of each piece's remainder.  Groups are counted first and cut into blocks
of about TILE words; every two blocks of a group are one tile, so a group of
any size is spread over many tasks and nothing is left out.  A pair counts in
the first piece that its prefix and suffix allow, so once.  A tile answers with
one row per word (near words, best near word), not with pairs.

A word's form is its near word of largest count (ties: first in code-point
order) if that is RATIO times its own or more.  Counts grow along forms, so
the chains end; roots are found by doubling the steps.

Joins are merges by a hint: the groups are an explode of the words and the scratch
tables compressed, so Spark takes tables that grow with the corpus for small
enough to collect them on the driver and broadcast them.

Cases: null and empty texts have no words, a null id is the word null in the
typing-error rule; repeated rows count as often as they occur; empty tables give
no rows; columns other than id and text are not looked at.  In ``variants``,
null words and null counts take no part and counts of repeated words add up.
Long words are compared in slices of CELLS code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuelens.llm import blocks as B

#: Words of the corpus, and what is lower-cased in them.
LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT = 5, 3
#: One run in so many loses a code point (see ``runs``).
TYPO = 97
#: A form is at least so many times as frequent.
RATIO = 2
PIECES = 3
#: Words of a block, about; a tile compares two blocks.
TILE = 1024
#: Code points of one side that are compared at once.
CELLS = 1 << 21

_TILES = "m int, piece int, a_word array<string>, a_n array<long>, b_word array<string>, b_n array<long>"
_FOUND = "word string, n_near long, best_n long, best string"


def runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", typo: int = TYPO) -> DataFrame:
    """``(run)``: every letter run of the texts, A-Z lower-cased.

    Where ``typo`` divides h, the unsigned crc32 of ``<id>:<run>``, the run's code
    point h mod its length is missing.
    """
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(LETTERS), F.lit(0)))
    df = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("_id"), run.alias("_run"))
    ascii_only = F.octet_length("_run") == F.length("_run")
    df = df.withColumn("_run", F.when(ascii_only, F.lower("_run")).otherwise(F.translate("_run", UPPER, LOWER)))
    df = df.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")))
    at = (F.col("_h") % F.length("_run")).cast("int")
    cut = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.length("_run")))
    return df.select(F.when(F.col("_h") % typo == 0, cut).otherwise(F.col("_run")).alias("run"))


def count_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, typo: int = TYPO) -> DataFrame:
    """``(word, n)`` of the runs that are long and frequent enough."""
    return (runs(docs, id_col, text, typo).where(F.length("run") >= min_length)
            .groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


def members(words: DataFrame) -> DataFrame:
    """``(g, m, piece, word, n)``: the groups that a word joins; a group is a hash of m, piece and the rest of the word."""
    def group(m: Column, piece: int) -> Column:
        lo, hi = F.floor(m * piece / PIECES).cast("int"), F.floor(m * (piece + 1) / PIECES).cast("int")
        rest = F.array(F.substring(F.col("word"), F.lit(1), lo), F.right(F.col("word"), m - hi))
        return F.struct(F.xxhash64(m, F.lit(piece), rest).alias("g"), m.alias("m"), F.lit(piece).alias("piece"))

    groups = F.array(*(group(F.col("_len") - less, piece) for less in (0, 1) for piece in range(PIECES)))
    df = words.withColumn("_len", F.length("word")).select("word", "n", F.explode(groups).alias("_g"))
    return df.where("_g.m > 0").select("_g.*", "word", "n")


def tiles(spark: SparkSession, words: DataFrame) -> DataFrame:
    """Rows of ``_TILES``: a block with itself (b empty), or two blocks of one group."""
    joined = members(words)
    short = F.length("word") == F.col("m")
    sizes = (joined.groupBy("g").agg(F.count("*").alias("size"), F.count_if(short).alias("short"))
             .where("short > 0 and size > 1").select("g", F.ceil(F.col("size") / TILE).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block")
    made = (joined.join(sizes.hint("merge"), "g").groupBy("g", "blocks", block)
            .agg(F.first("m").alias("m"), F.first("piece").alias("piece"), F.collect_list("word").alias("word"),
                 F.collect_list("n").alias("n")))
    made = B.scratch_table(spark, made, "variant-blocks")
    alone = made.select("m", "piece", F.col("word").alias("a_word"), F.col("n").alias("a_n"),
                        F.array().cast("array<string>").alias("b_word"), F.array().cast("array<long>").alias("b_n"))
    # two blocks meet under (g, smaller number, larger number): each block goes once to every other
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = made.where("blocks > 1").select("*", other.alias("other")).where("other <> block")
    met = (met.groupBy("g", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
           .agg(F.first("m").alias("m"), F.first("piece").alias("piece"),
                F.collect_list(F.struct("word", "n")).alias("two")).where("size(two) = 2"))
    met = met.select("m", "piece", F.expr("two[0].word AS a_word"), F.expr("two[0].n AS a_n"),
                     F.expr("two[1].word AS b_word"), F.expr("two[1].n AS b_n"))
    return alone.union(met)


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Concatenated ranges."""
    n = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


class _Words:
    """Words of a batch of tiles, as one array of code points."""

    def __init__(self, words: pa.Array):
        self.size = np.asarray(pc.utf8_length(words), np.int64)
        self.end = np.cumsum(self.size)
        codes = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
        self.codes = codes.astype(np.uint8) if len(codes) and codes.max() < 256 else codes

    def padded(self, which: np.ndarray, width: int, backward: bool) -> np.ndarray:
        """A row for each of ``which``, from its front or from its back, zeros behind."""
        size = self.size[which]
        col = np.arange(width)
        at = (self.end[which] - 1)[:, None] - col if backward else (self.end[which] - size)[:, None] + col
        inside = col < size[:, None]
        return np.where(inside, self.codes[np.where(inside, at, 0)], 0).astype(self.codes.dtype)


def _candidates(size: np.ndarray, m: np.ndarray, row: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(order, left, lo, hi)``: word ``order[left]`` meets ``order[lo:hi]``; words of length m + 1 never meet each other."""
    long = size > m[row]
    order = np.lexsort((long, side, row))
    key = (row[order] * 2 + side[order]) * 2 + long[order]
    n_rows = len(m)
    cut = np.searchsorted(key, np.arange(4 * n_rows + 1))  # per row: a short, a long, b short, b long
    a0, a1, b0, b1 = (cut[k:4 * n_rows:4] for k in range(4))
    end = cut[4::4]
    at = np.arange(len(order))
    r = row[order]
    first, is_long = side[order] == 0, long[order]
    own = first & ~is_long                    # a short word meets the words behind it in its block ...
    across = first & (end[r] > b0[r])         # ... and of the other block all, a long one the short
    left = np.concatenate([at[own], at[across]])
    lo = np.concatenate([at[own] + 1, b0[r][across]])
    hi = np.concatenate([b0[r][own], np.where(is_long, b1[r], end[r])[across]])
    two = (end > b0)[r[left]] & (np.arange(len(left)) < own.sum())
    keep = (hi > lo) & ~two                   # a block met itself in its own tile
    return order, left[keep], lo[keep], hi[keep]


def near_pairs(words: pa.Array, m: np.ndarray, piece: np.ndarray, row: np.ndarray,
               side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of near words; ``row`` and ``side`` tell the tile of a word and the block in it."""
    w = _Words(words)
    order, left, lo, hi = _candidates(w.size, m, row, side)
    if not len(left):
        return
    width = m[row[order[left]]] + 1
    # a left word with very many cells meets its partners in parts
    most = np.maximum(CELLS // width, 1)
    parts = -(-(hi - lo) // most)
    part = _spans(np.zeros(len(left), np.int64), parts)
    left, lo, hi, most, width = (np.repeat(x, parts) for x in (left, lo, hi, most, width))
    lo = lo + part * most
    hi = np.minimum(hi, lo + most)
    by_width = np.argsort(width, kind="stable")
    left, lo, hi, width = left[by_width], lo[by_width], hi[by_width], width[by_width]
    cells = np.cumsum((hi - lo) * width)
    i = 0
    while i < len(left):
        j = max(int(np.searchsorted(cells, (cells[i - 1] if i else 0) + CELLS, side="right")), i + 1)
        a = order[np.repeat(left[i:j], hi[i:j] - lo[i:j])]
        b = order[_spans(lo[i:j], hi[i:j])]
        used, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        at_a, at_b = where[:len(a)], where[len(a):]
        front, back = (w.padded(used, int(width[j - 1]), x) for x in (False, True))
        prefix = (front[at_a] != front[at_b]).argmax(1)
        suffix = (back[at_a] != back[at_b]).argmax(1)
        short, k = m[row[a]], piece[row[a]]
        near = prefix + suffix >= np.maximum(w.size[a], w.size[b]) - 1

        def allowed(k: np.ndarray) -> np.ndarray:
            return (prefix >= short * k // PIECES) & (suffix >= short - short * (k + 1) // PIECES)

        near &= allowed(k) & ~((k > 0) & allowed(np.maximum(k - 1, 0)))
        yield a[near], b[near]
        i = j


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = {name: batch.column(name) for name in batch.schema.names}
        m, piece = (np.asarray(cols[c], dtype=np.int64) for c in ("m", "piece"))
        words = pa.concat_arrays([cols["a_word"].flatten(), cols["b_word"].flatten()])
        n = np.concatenate([np.asarray(cols["a_n"].flatten()), np.asarray(cols["b_n"].flatten())]).astype(np.int64)
        in_a, in_b = (np.asarray(pc.list_value_length(cols[c]), np.int64) for c in ("a_word", "b_word"))
        row = np.concatenate([np.repeat(np.arange(len(m)), in_a), np.repeat(np.arange(len(m)), in_b)])
        side = np.repeat([0, 1], [in_a.sum(), in_b.sum()])
        best_first = np.asarray(pc.sort_indices(pa.table({"n": n, "w": words}),
                                                sort_keys=[("n", "descending"), ("w", "ascending")]))
        rank = np.empty(len(n), np.int64)
        rank[best_first] = np.arange(len(n))
        count, best = np.zeros(len(n), np.int64), np.full(len(n), len(n))
        for a, b in near_pairs(words, m, piece, row, side):
            for x, y in ((a, b), (b, a)):
                count += np.bincount(x, minlength=len(n))
                np.minimum.at(best, x, rank[y])
        found = np.flatnonzero(count)
        chosen = best_first[best[found]]
        yield pa.record_batch([words.take(pa.array(found)), pa.array(count[found]), pa.array(n[chosen]),
                               words.take(pa.array(chosen))], names=["word", "n_near", "best_n", "best"])


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """``(word, root)`` of every word with a form, from ``(word, form)``; forms must not run in circles."""
    now = B.scratch_table(spark, forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(ahead.hint("merge"), "root", "left")
        step = B.scratch_table(spark, step.select("word", F.coalesce("next", "root").alias("root"),
                                                  F.col("next").isNotNull().alias("moved")), "variant-roots")
        now = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return now


def variants(spark: SparkSession, words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``words`` (word, n)."""
    words = words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = B.scratch_table(spark, words, "variant-words")
    found = tiles(spark, words).mapInArrow(_compare, _FOUND)
    none = F.lit(None)
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.cast("long").alias("best_n"),
                         none.cast("string").alias("best"))
    found = found.select("word", none.cast("long").alias("n"), "n_near", "best_n", "best")
    least = F.min(F.when(F.col("best_n").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))))
    one = every.union(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), least.alias("_b"))
    has_form = -F.col("_b.n") >= ratio * F.col("n")
    one = one.select("word", "n", "n_near", F.when(has_form, F.col("_b.w")).alias("form"),
                     F.when(has_form, -F.col("_b.n")).alias("form_n"))
    one = B.scratch_table(spark, one, "variant-forms")
    last = roots(spark, one.where("form is not null"))
    return (one.join(last.hint("merge"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(spark, count_words(docs))


#: The same in SQL: crc32 byte by byte with its table, near words by what is left of a word without one code point.
ORACLE = rf"""
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i:
         CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{LETTERS}')), '{UPPER}', '{LOWER}') AS run FROM documents),
kinds AS MATERIALIZED (SELECT run, coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run AS s, count(*) AS k FROM runs GROUP BY ALL),
coded AS (SELECT run, k, flatten(list_transform(string_split(s, ''), lambda x:
                 CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END))::BIGINT[] AS bytes FROM kinds),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b:
                  xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS h FROM coded, tab),
cut AS (SELECT CASE WHEN h % {TYPO} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k
        FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= {MIN_LENGTH}
                       GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
less AS MATERIALIZED (SELECT word, p, left(word, p) || substr(word, p + 2) AS d FROM words, unnest(range(length(word))) AS u(p)),
near AS MATERIALIZED (
  SELECT a.word AS x, b.word AS y FROM less a JOIN less b ON a.p = b.p AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, w.word FROM less a JOIN words w ON w.word = a.d
  UNION SELECT w.word, a.word FROM less a JOIN words w ON w.word = a.d),
best AS (SELECT x AS word, count(*) AS n_near, min_by(y, (-n, y)) AS y, max(n) AS n FROM near JOIN words ON words.word = y GROUP BY x),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= {RATIO} * w.n THEN y END AS form,
         CASE WHEN b.n >= {RATIO} * w.n THEN b.n END AS form_n FROM words w LEFT JOIN best b USING (word)),
chain AS (SELECT word, form AS root FROM forms WHERE form IS NOT NULL
          UNION ALL SELECT chain.word, f.form FROM chain JOIN forms f ON f.word = chain.root WHERE f.form IS NOT NULL),
ends AS (SELECT chain.word, chain.root FROM chain JOIN forms f ON f.word = chain.root WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)
"""
