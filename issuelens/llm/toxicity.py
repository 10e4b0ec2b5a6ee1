"""Toxicity by a weighted finite-state pattern grammar.

Words carry classes: insult and threat words, targets, negations and words of
reported speech.  Small transducers (negation, reported speech, target)
rewrite a clause's classes, and their composition, one deterministic machine,
tags each insult and threat of the clause: plain, negated, reported, aimed at
somebody.  A clause's score is the sum of its matches' weights by tag; a
document's features are these sums over its matched clauses, and a logistic
model turns them into a score.

Insult words and their weights come from labelled documents (log ratio of the
shares of toxic and clean documents that have the word, kept if the evidence,
a log-likelihood ratio, is at least EVIDENCE); the listed ones are there from
the start.  The classifier is fitted on at most about LABELLED rows, chosen
by a hash of doc_id, with at most LEXICON words: both bound what is broadcast
and what the driver holds.  Scoring reads every whole text.

Cases: null or empty texts have no clause and get the score of no evidence;
labels that are null are not learned from; without labels, or with labels of
one kind only, the score of no evidence is the smoothed share of toxic ones;
null doc_ids are scored and never learned from; repeated rows are scored
each; labels of a document that disagree are all learned; empty tables give
no rows.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelens.llm import tokens as K

FOLDS = 5
LABELLED = 20_000
LEXICON = 5_000
EVIDENCE = 18.0
#: Weight of listed words that labels say nothing about.
LISTED = 2.0

# Word lists of the grammar.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting imbecile dumb".split()
THREATS = "kill murder hurt stab shoot destroy beat burn strangle hang".split()
TARGETS = ("you your yours u ur him her them he she they his their people "
           "du dich dir sie euch ihr tu te toi vous tes vos ustedes tus").split()
NEGATIONS = "not no never don't isn't aren't wasn't nobody nor nicht kein keine pas jamais nunca".split()
REPORTS = ("said says say told tells called calls wrote writes quoted quotes claims claimed reported "
           "sagte sagt disait dijo dice").split()

NONE, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Tags are bits on an INSULT or THREAT; 8 and more keep clear of the classes.
NEGATED, REPORTED, AIMED = 8, 16, 32
SCOPE = 3
_ALPHABET = range(6)


class Transducer:
    """A deterministic machine: ``next[state][symbol] = (state, symbol out)``."""

    def __init__(self, table: list[dict[int, tuple[int, int]]]):
        self.table = table

    def run(self, symbols) -> list[int]:
        state, out = 0, []
        for s in symbols:
            state, o = self.table[state][s]
            out.append(o)
        return out


def build(step, alphabet) -> Transducer:
    """The machine of ``step(state, symbol) -> (state, out)`` from state None, over the states it reaches."""
    number, table, todo = {None: 0}, [], deque([None])
    while todo:
        state = todo.popleft()
        row = {}
        for s in alphabet:
            to, out = step(state, s)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row[s] = (number[to], out)
        table.append(row)
    return Transducer(table)


def compose(first: Transducer, second: Transducer, alphabet) -> Transducer:
    """The machine whose output is ``second`` run on the output of ``first``."""
    def step(state, symbol):
        a, b = state or (0, 0)
        a, mid = first.table[a][symbol]
        b, out = second.table[b][mid]
        return (a, b), out

    return build(step, alphabet)


def _is_match(s: int) -> bool:
    return s & 7 in (INSULT, THREAT)


def _negation(state, s):
    left = SCOPE if s == NEGATION else max((state or 0) - 1, 0)
    return left or None, s | NEGATED if _is_match(s) and state else s


def _report(state, s):
    return state or (s == REPORT) or None, s | REPORTED if _is_match(s) and state else s


def _aim(state, s):
    return state or (s == TARGET) or None, s | AIMED if _is_match(s) and state else s


_MID = [*_ALPHABET, *(m | t for m in (INSULT, THREAT) for t in range(8, 64, 8))]
#: Left to right: negation, then reported speech, then a target before the match.
GRAMMAR = compose(compose(build(_negation, _ALPHABET), build(_report, _MID), _ALPHABET), build(_aim, _MID), _ALPHABET)
#: Right to left over its output: a target after the match.
AIM_BACK = build(_aim, _MID)


def tag(classes: list[int]) -> list[int]:
    """A clause's classes with tags on its insults and threats."""
    return AIM_BACK.run(GRAMMAR.run(classes)[::-1])[::-1]


#: plain, negated, reported, aimed insults; threats that are aimed and not reported or negated; other threats
FEATURES = 6


def _feature(s: int) -> int:
    if s & 7 == THREAT:
        return 4 if s & AIMED and not s & (NEGATED | REPORTED) else 5
    return 2 if s & REPORTED else 1 if s & NEGATED else 3 if s & AIMED else 0


_BREAK = np.zeros(256, np.int64)
_BREAK[[ord(c) for c in ".;:!?\n"]] = 1


class Lexicon:
    """Word classes and weights by word hash."""

    def __init__(self, learned: list[tuple[int, float]]):
        classes = {}
        for words, kind in ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT), (INSULTS, INSULT)):
            classes |= {h: (kind, LISTED) for h in hash_words(words)}
        classes |= {h & (1 << 64) - 1: (INSULT, w) for h, w in learned}
        keys = np.array(sorted(classes), np.uint64)
        self.keys = keys
        self.kind = np.array([classes[int(k)][0] for k in keys], np.int64)
        self.weight = np.array([classes[int(k)][1] for k in keys])

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        known = self.keys[at] == h
        return np.where(known, self.kind[at], NONE), np.where(known, self.weight[at], 0.0)


_APOSTROPHE = K.ALNUM.copy()
_APOSTROPHE[0x27] = True


def _tokens(data: np.ndarray, off: np.ndarray) -> K.Words:
    return K.words(data, off, _APOSTROPHE, lower=True)


def hash_words(words: list[str]) -> list[int]:
    data, off = K.buffers(pa.array(words))
    return _tokens(data, off).hash.tolist()


def clause_features(w: K.Words, lexicon: Lexicon) -> np.ndarray:
    """Per document the weights of its matched clauses by feature."""
    kind, weight = lexicon.look(w.hash)
    out = np.zeros((w.n_docs, FEATURES))
    hits = np.flatnonzero((kind == INSULT) | (kind == THREAT))
    if not len(hits):
        return out
    breaks = np.concatenate([[0], np.cumsum(_BREAK[w.data])])
    clause = breaks[w.start] + w.doc_of()  # a document's end breaks as well
    first = np.searchsorted(clause, clause[hits], side="left")
    last = np.searchsorted(clause, clause[hits], side="right")
    doc = np.searchsorted(w.first, hits, side="right") - 1
    done = -1
    for a, z, d in zip(first.tolist(), last.tolist(), doc.tolist()):
        if a == done:
            continue
        done = a
        # only words with a class move the machine, save for the distance a negation reaches
        for i, s in enumerate(tag(kind[a:z].tolist())):
            if _is_match(s):
                out[d, _feature(s)] += weight[a + i]
    return out


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.log1p(x), np.log1p(x.sum(1))])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the constant is not shrunk."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    beta = np.zeros(FEATURES + 2)
    beta[0] = np.log(share / (1 - share))
    if not 0 < y.sum() < len(y):
        return beta
    d = _design(x)
    penalty = np.full(len(beta), ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ beta, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.diag(penalty), d.T @ (y - p) - penalty * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fold_of(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def _count(batches):
    """Documents by word hash and label; the row of word 0 counts all documents."""
    schema = pa.schema([("word", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi, data, off in K.text_slices(batch.column(0)):
            w = _tokens(data, off)
            doc = w.doc_of()
            order = np.lexsort((doc, w.hash))
            h, doc = w.hash[order], doc[order]
            if len(h):
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
                h, doc = h[new], doc[new]
            toxic = label[lo:hi][doc]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            t = np.add.reduceat(toxic, first) if len(h) else first
            n = np.diff(np.append(first, len(h)))
            mine = label[lo:hi]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.append(h[first], np.uint64(0)).view(np.int64)),
                pa.array(np.append(t, mine.sum())), pa.array(np.append(n - t, len(mine) - mine.sum()))], schema=schema)
    K.give_back()


def _part(t: str, n: str, total: str) -> str:
    """t * ln(share of t in n against the share in all), 0 for 0."""
    return f"case when {t} > 0 then {t} * ln({t} * {total} / {n}) else 0 end"


def learn_words(sample: DataFrame) -> list[tuple[int, float]]:
    """Insult words ``(hash, weight)`` of labelled texts (text, toxic): the LEXICON ones of most evidence."""
    counts = sample.select("text", "toxic").mapInArrow(_count, "word long, toxic long, clean long").groupBy("word").agg(
        F.sum("toxic").cast("double").alias("t"), F.sum("clean").cast("double").alias("c"))
    total = counts.where("word = 0").first()
    if total is None or not total.t or not total.c:
        return []
    n_t, n_c = total.t, total.c
    n = n_t + n_c
    counts = counts.where("word <> 0 and t >= 3").withColumns({"a": F.lit(n_t) - F.col("t"), "b": F.lit(n_c) - F.col("c")})
    g = " + ".join((_part("t", f"((t + c) * {n_t!r})", repr(n)), _part("c", f"((t + c) * {n_c!r})", repr(n)),
                    _part("a", f"((a + b) * {n_t!r})", repr(n)), _part("b", f"((a + b) * {n_c!r})", repr(n))))
    weight = f"ln((t + 0.5) / {n_t + 1!r}) - ln((c + 0.5) / {n_c + 1!r})"
    found = counts.select("word", F.expr(weight).alias("w"), F.expr(f"2 * ({g})").alias("g")).where(
        f"w > 0 and g >= {EVIDENCE}")
    return [(r.word, r.w) for r in found.orderBy(F.desc("g"), "word").limit(LEXICON).collect()]


def _collect_features(lexicon: Lexicon):
    def features(batches):
        for batch in batches:
            label = batch.column(1)
            for lo, hi, data, off in K.text_slices(batch.column(0)):
                x = clause_features(_tokens(data, off), lexicon)
                yield pa.RecordBatch.from_arrays(
                    [label.slice(lo, hi - lo).cast(pa.int64()), *(pa.array(x[:, k]) for k in range(FEATURES))],
                    names=["toxic", *(f"x{k}" for k in range(FEATURES))])
        K.give_back()
    return features


class Model:
    def __init__(self, lexicon: Lexicon, beta: np.ndarray):
        self.lexicon, self.beta = lexicon, beta

    def scores(self, w: K.Words) -> np.ndarray:
        z = _design(clause_features(w, self.lexicon)) @ self.beta
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """The grammar's weights from labelled documents outside the held-out fold."""
    rows = labels.where((fold_of(id_col, FOLDS) != 0) & F.col(toxic).isNotNull())
    n = rows.count()
    share = min(1.0, LABELLED / n) if n else 1.0
    rows = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < share * 1_000_000)
    rows = rows.select(F.col(id_col).alias("id"), F.col(toxic).cast("long").alias("toxic"))
    # about LABELLED rows of two numbers: small enough for every task
    sample = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(rows), "id")
    lexicon = Lexicon(learn_words(sample))
    got = sample.select("text", "toxic").mapInArrow(
        _collect_features(lexicon), "toxic long, " + ", ".join(f"x{k} double" for k in range(FEATURES))).toPandas()
    return Model(lexicon, fit(got[[f"x{k}" for k in range(FEATURES)]].to_numpy(), (got["toxic"] > 0).to_numpy(float)))


def score_documents(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, replacing a column of that name."""
    docs = docs.drop("score")
    shared = spark.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text))
            got = [shared.value.scores(_tokens(data, off)) for _, _, data, off in K.text_slices(col)]
            yield batch.append_column("score", pa.array(np.concatenate(got) if got else np.zeros(0)))
        K.give_back()

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by the grammar learned outside fold 0 of doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(spark, docs, model)
    return scored.select("doc_id", F.coalesce(fold_of("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
