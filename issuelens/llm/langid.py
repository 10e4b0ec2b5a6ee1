"""Language identification: known words first, shorter character n-grams for the rest.

A word (a run of letters' and other non-ASCII bytes, A-Z lower-cased) that
training knows adds its log frequency in each language.  An unseen word backs
off: the mean log frequency of its known character 5-grams (with the word's
borders), if it has none its 4-grams, and so on to single characters.  The
language of the largest sum is predicted, its posterior is the score.

The languages are those of all labelled rows to learn from.  The model is
fitted on about TRAIN_DOCS documents at most, chosen by a hash of doc_id: as many of each language, all
of a language that has fewer.  It keeps KEYS words, those that are most
frequent in some language first, and as many n-grams of each
length (fewer, if there are so many languages that the tables would pass
CELLS numbers): this bounds what the driver holds and what is broadcast.
Prediction reads every whole text.

Cases: a null text or one without a letter is ``und`` with score 0, as is
every text if nothing was learned; null languages are not learned from; ties
go to the first language by code point; null doc_ids are predicted and never
learned from; repeated rows are predicted each; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.llm import blocks as B
from issuelens.llm import tokens as K
from issuelens.llm.toxicity import fold_of

FOLDS = 5
TRAIN_DOCS = 20_000
KEYS = 100_000
CELLS = 4_000_000
LONGEST = 5
SMOOTHING = 0.1
UNKNOWN = "und"
RESULT = ("lang_pred", "score")

_LETTERS = K.ALNUM.copy()
_LETTERS[0x30:0x3A] = False


def _distinct_words(data: np.ndarray, off: np.ndarray) -> tuple[K.Words, np.ndarray, np.ndarray]:
    """Words of the texts, the place of one word of each kind, and each word's kind."""
    w = K.words(data, off, _LETTERS, lower=True)
    _, place, kind = np.unique(w.hash, return_index=True, return_inverse=True)
    return w, place, kind


def _spell(w: K.Words, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words at ``place``, each between two spaces, and where each begins."""
    raw = w.data.tobytes()
    text = b" ".join(raw[a:z] for a, z in zip(w.start[place].tolist(), w.end[place].tolist())) + b" "
    points = np.frombuffer((" " + text.decode("utf-8", "replace")).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return points, np.flatnonzero(points == 32)


def ngrams(w: K.Words, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of the words at ``place``, and the word (by number) of each.

    From two characters on the border spaces count; n-grams do not cross words.
    """
    if not len(place):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    points, border = _spell(w, place)
    m = len(points) - n + 1
    if m < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h = h * K.BASE + points[k:m + k]
    spaces = np.concatenate([[0], np.cumsum(points == 32)])
    at = np.arange(m)
    # none, one at either end, or for a whole word both; a space inside is another word's
    inner = spaces[at + n - 1] - spaces[at + 1] if n > 1 else spaces[at + 1] - spaces[at]
    ok = inner == 0
    word = np.searchsorted(border, at, side="right") - 1
    ok &= word < len(place)
    return K.mix(h[ok]), word[ok]


def _totals(keys: np.ndarray, lang: np.ndarray, n: np.ndarray, languages: int):
    code = np.unique(keys, return_inverse=True)
    sums = np.bincount(code[1] * languages + lang, weights=n, minlength=len(code[0]) * languages)
    at = np.flatnonzero(sums)
    return code[0][at // languages], at % languages, sums[at].astype(np.int64)


def _count(languages: list[str]):
    """``(size, key, lang, n)``: size 0 for words, 1 to LONGEST for character n-grams."""
    number = {x: i for i, x in enumerate(languages)}

    def count(batches):
        for batch in batches:
            labels = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for lo, hi, data, off in K.text_slices(batch.column(0)):
                w, place, kind = _distinct_words(data, off)
                lang = np.repeat(labels[lo:hi], w.counts)
                pair = np.bincount(kind * len(languages) + lang, minlength=len(place) * len(languages))
                at = np.flatnonzero(pair)
                of_word, of_lang, n = at // len(languages), at % len(languages), pair[at]
                for size in range(LONGEST + 1):
                    if size:
                        grams, word = ngrams(w, place, size)
                        order = np.argsort(word, kind="stable")
                        grams, word = grams[order], word[order]
                        first = np.searchsorted(word, np.arange(len(place) + 1))
                        reps = (first[1:] - first[:-1])[of_word]
                        index = np.repeat(first[of_word] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum()) if len(reps) else reps
                        keys, langs, ns = _totals(grams[index], np.repeat(of_lang, reps), np.repeat(n, reps), len(languages))
                    else:
                        keys, langs, ns = w.hash[place][of_word], of_lang, n
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), size)), pa.array(keys.view(np.int64)), pa.array(langs), pa.array(ns)],
                        names=["size", "key", "lang", "n"])
    return count


class Model:
    """Per n-gram length (0: words) the sorted keys and their log frequency by language."""

    def __init__(self, languages: list[str], tables: list[tuple[np.ndarray, np.ndarray]]):
        self.languages, self.tables = languages, tables

    def _look(self, size: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, _ = self.tables[size]
        if not len(keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return at, keys[at] == h

    def word_scores(self, w: K.Words, place: np.ndarray) -> np.ndarray:
        """Log frequencies (words by languages), backed off for unseen words."""
        out = np.zeros((len(place), len(self.languages)))
        at, known = self._look(0, w.hash[place])
        out[known] = self.tables[0][1][at[known]]
        left = np.flatnonzero(~known)
        for size in range(LONGEST, 0, -1):
            if not len(left):
                break
            grams, word = ngrams(w, place[left], size)
            at, known = self._look(size, grams)
            at, word = at[known], word[known]
            n = np.bincount(word, minlength=len(left))
            found = n > 0
            for k in range(len(self.languages)):
                total = np.bincount(word, weights=self.tables[size][1][at, k], minlength=len(left))
                out[left[found], k] = total[found] / n[found]
            left = left[~found]
        return out

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and posterior of the likeliest language of each text."""
        w, place, kind = _distinct_words(data, off)
        scores = self.word_scores(w, place)
        doc = w.doc_of()
        total = np.stack([np.bincount(doc, weights=scores[kind, k], minlength=w.n_docs)
                          for k in range(len(self.languages))], axis=1)
        best = total.argmax(1)
        return best, 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)


def _even(sizes: dict[str, int], docs: int) -> float:
    """So many documents of each language, or all it has, make ``docs`` together."""
    left, level = docs, 0.0
    for k, n in enumerate(sorted(sizes.values())):
        level = left / (len(sizes) - k)
        if n > level:
            return max(level, 1.0)
        left -= n
    return float(max(sizes.values(), default=0))


def train(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model of the texts outside the held-out fold whose language is known."""
    rows = docs.where((fold_of(id_col, FOLDS) != 0) & F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], [])
    level = _even(sizes, TRAIN_DOCS)
    rows = rows.select(F.col(id_col).alias("_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).join(
        F.broadcast(spark.createDataFrame([(x, min(1.0, level / n)) for x, n in sizes.items()], "lang string, _share double")),
        "lang").where(F.pmod(F.xxhash64("_id"), F.lit(10 ** 9)) < F.col("_share") * 10 ** 9)
    keys = max(min(KEYS, CELLS // len(languages)), 1)
    counts = rows.select("text", "lang").mapInArrow(
        _count(languages), "size long, key long, lang long, n long").groupBy("size", "key", "lang").agg(F.sum("n").alias("n"))
    counts = B.scratch_table(spark, counts, "language-counts")
    sums = counts.groupBy("size", "lang").agg(F.sum("n").alias("total"))
    got = counts.join(F.broadcast(sums), ["size", "lang"]).groupBy("size", "key").agg(
        F.sum("n").alias("n"), F.max(F.col("n") / F.col("total")).alias("most"), F.map_from_entries(
        F.collect_list(F.struct("lang", "n"))).alias("by"))
    totals = {(r["size"], r["lang"]): r["total"] for r in sums.collect()}
    tables = []
    for size in range(LONGEST + 1):
        top = got.where(F.col("size") == size).orderBy(F.desc("most"), F.desc("n"), "key").limit(keys).select(
            "key", *(F.coalesce(F.col("by")[F.lit(k)], F.lit(0)).alias(f"n{k}") for k in range(len(languages)))).toPandas()
        top["key"] = top["key"].to_numpy().view(np.uint64)
        top = top.sort_values("key")
        n = top[[f"n{k}" for k in range(len(languages))]].to_numpy(float)
        all_n = np.array([totals.get((size, k), 0) for k in range(len(languages))], float)
        log = np.log((n + SMOOTHING) / (all_n + SMOOTHING * (len(n) + 1)))
        tables.append((top["key"].to_numpy(np.uint64), log.astype(np.float32)))
    return Model(languages, tables)


def identify(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, replacing columns of these names."""
    docs = docs.drop(*RESULT)
    shared = spark.sparkContext.broadcast(model)

    def predict(batches):
        names = np.array([*shared.value.languages, UNKNOWN], object)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text))
            lang, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, data, off in K.text_slices(col):
                best, p = shared.value.predict(data, off)
                lang.append(best)
                score.append(p)
            yield (batch.append_column("lang_pred", pa.array(names[np.concatenate(lang)].tolist(), pa.string()))
                   .append_column("score", pa.array(np.concatenate(score))))

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if not model.languages:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    found = docs.mapInArrow(predict, schema)
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return found.withColumns({"lang_pred": F.when(letters, F.col("lang_pred")).otherwise(UNKNOWN),
                              "score": F.when(letters, F.col("score")).otherwise(0.0)})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by a model learned outside fold 0 of doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(spark, docs.select("doc_id", "text"), train(spark, docs))
    return found.select("doc_id", F.coalesce(fold_of("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out"),
                        "lang_pred", "score")
