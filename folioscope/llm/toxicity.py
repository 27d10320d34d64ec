"""Toxicity by a classifier chain.

Categories are predicted one after the other; each is a linear (logistic) model
over the words and stems that tell it apart, a few measures of the text's form, and the
probabilities of the categories before it. In training those probabilities come
out of fold, so a later model sees the errors that it will see in use.
The models are fitted on a bounded sample of labelled documents; every document
is scored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, stored, table
from .tokens import Memo

#: Labelled documents that the models are fitted on, at most.
SAMPLE = 12_000
FOLDS = 3
#: Words that one model weighs, at most, and documents a word must be in.
WORDS, LEAST_DOCS = 400, 5
#: Rows whose features a task holds at once.
ROWS = 512
#: Words that the models may use at most.
VOCABULARY = 1 << 21
#: Lengths of the stems that count as features beside whole words.
STEMS = (4, 5)
CATEGORIES = ("low_quality", "toxic")
FORM = 5

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def form_of(text: str | None) -> list[float]:
    """log length, and the shares of capitals, digits, marks and white space."""
    if not text:
        return [0.0] * FORM
    raw = np.frombuffer(text.encode(), np.uint8)
    n = len(raw)
    kind = _KIND[raw]
    counts = np.bincount(kind, minlength=5)
    return [np.log1p(n) / 10, *(counts[1:5] / n * 5).tolist()]


_KIND = np.zeros(256, np.uint8)
for _c in range(128):
    _KIND[_c] = 1 if chr(_c).isupper() else 2 if chr(_c).isdigit() else 4 if chr(_c).isspace() else 0 if chr(_c).isalpha() else 3


class Linear:
    """Logistic regression over a dictionary of words and dense features."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, dense: np.ndarray, bias: float):
        self.words, self.weights, self.dense, self.bias = words, weights, dense, bias

    @staticmethod
    def fit(docs: list[np.ndarray], dense: np.ndarray, y: np.ndarray, vocabulary: np.ndarray, l2: float = 1.0, steps: int = 150) -> Linear:
        """docs: places of each document's distinct words in ``vocabulary``, their sorted 64-bit hashes."""
        n, pos = len(docs), float(y.sum())
        if not n or pos in (0.0, float(n)):
            rate = (pos + 0.5) / (n + 1.0)
            return Linear(np.empty(0, np.uint64), np.empty(0), np.zeros(dense.shape[1]), float(np.log(rate / (1 - rate))))
        df, with_y = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary))
        for d, v in zip(docs, y, strict=True):
            df[d] += 1
            with_y[d] += v
        rate = pos / n
        z = np.abs(with_y - df * rate) / np.sqrt(np.maximum(df, 1) * rate * (1 - rate))
        z[df < LEAST_DOCS] = 0
        keep = np.sort(np.argsort(-z, kind="stable")[:WORDS])
        keep = keep[z[keep] > 3.0]
        place = np.full(len(vocabulary), -1, np.int32)
        place[keep] = np.arange(len(keep))
        columns = [c[c >= 0] for c in (place[d] for d in docs)]
        row = np.repeat(np.arange(n), [len(c) for c in columns])
        column = np.concatenate([*columns, np.empty(0, np.int32)])
        k = len(keep)
        w, d, b = np.zeros(k), np.zeros(dense.shape[1]), float(np.log(rate / (1 - rate)))
        mw, md, mb = w.copy(), d.copy(), b
        # Nesterov's method with one safe step size from the squared norms.
        rows_len = np.bincount(row, minlength=n) + (dense**2).sum(axis=1) + 1
        step = 4.0 / (np.quantile(rows_len, 0.99) * n / 4 + l2)
        for t in range(steps):
            s = np.bincount(row, weights=mw[column], minlength=n) + dense @ md + mb
            e = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - y
            gw, gd, gb = np.bincount(column, weights=e[row], minlength=k) + l2 * mw, dense.T @ e + l2 * md, e.sum()
            nw, nd, nb = mw - step * gw, md - step * gd, mb - step * gb
            f = t / (t + 3)
            mw, md, mb = nw + f * (nw - w), nd + f * (nd - d), nb + f * (nb - b)
            w, d, b = nw, nd, nb
        return Linear(vocabulary[keep], w, d, b)

    def score(self, docs, dense: np.ndarray) -> np.ndarray:
        """Probabilities; docs: the sorted distinct word hashes of each document."""
        out = np.empty(len(dense))
        for i, x in enumerate(docs):
            k = np.searchsorted(self.words, x)
            k = k[(k < len(self.words))] if not len(self.words) else np.where(k < len(self.words), k, 0)
            hit = k[self.words[k] == x] if len(self.words) and len(x) else np.empty(0, int)
            out[i] = self.weights[hit].sum()
        return sigmoid(out + dense @ self.dense + self.bias)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Chain:
    """One linear model a category, in order; thresholds from out-of-fold predictions."""

    def __init__(self, categories, models, thresholds):
        self.categories, self.models, self.thresholds = categories, models, thresholds

    @staticmethod
    def fit(ids: np.ndarray, docs: list[np.ndarray], form: np.ndarray, labels: dict[str, np.ndarray], vocabulary: np.ndarray) -> Chain:
        """docs: places of each document's distinct words in ``vocabulary``, their sorted 64-bit hashes."""
        fold = np.array([xxhash.xxh3_64_intdigest(int(i).to_bytes(8, "little", signed=True)) % FOLDS for i in ids])
        dense, models, thresholds = form, [], []
        for name, y in labels.items():
            known = np.flatnonzero(~np.isnan(y))
            out = np.full(len(docs), np.nan)
            for f in range(FOLDS):
                fit = known[fold[known] != f]
                model = Linear.fit([docs[k] for k in fit], dense[fit], y[fit], vocabulary)
                own = np.flatnonzero(fold == f)
                out[own] = model.score((vocabulary[docs[k]] for k in own), dense[own])
            models.append(Linear.fit([docs[k] for k in known], dense[known], y[known], vocabulary))
            thresholds.append(best_threshold(out[known], y[known]))
            dense = np.column_stack([dense, out])
        return Chain(list(labels), models, thresholds)

    def predict(self, docs: list[np.ndarray], form: np.ndarray) -> np.ndarray:
        """One column of probabilities a category."""
        dense, out = form, []
        for model in self.models:
            out.append(model.score(docs, dense))
            dense = np.column_stack([dense, out[-1]])
        return np.column_stack(out)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the highest F1 (midway to the next score), kept within 0.2 and 0.8."""
    if not len(p) or not y.sum():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    k = int(np.argmax(f1))
    after = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order][k] + after) / 2, 0.2, 0.8))


def word_features(word: str) -> bytes:
    """Hashes of the word and of its stems (its first letters), for words built on one stem."""
    stems = [f"{word[:n]}*" for n in STEMS if len(word) > n]
    return b"".join(xxhash.xxh3_64_digest(w)[::-1] for w in (word, *stems))


def hashed(text: str | None, memo: Memo) -> np.ndarray:
    """Sorted distinct 64-bit features of a text's words."""
    return np.unique(np.frombuffer(b"".join(map(memo.__getitem__, words_of(text))), np.uint64))


def labelled_sample(documents: DataFrame, labels: DataFrame, names: list[str], most: int = SAMPLE, seed: int = 7) -> tuple[list, np.ndarray]:
    """At most ``most`` labelled documents, the smallest by a hash of their id, with the places of
    their words in the vocabulary; and the vocabulary, sorted word hashes.

    Of a repeated id one text counts, the one with the smallest hash. Words of
    fewer than LEAST_DOCS of them weigh nothing in any model; executors count
    them and leave them out, so the driver never holds them, and of the others it
    holds the VOCABULARY most frequent.
    """
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.col(c).cast("double")).alias(c) for c in names])
    sample = marks.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample.select("doc_id")), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select("doc_id", F.col("one.text").alias("text"))
    rows = rows.join(F.broadcast(sample), "doc_id").select("doc_id", *names, "text")

    def run(batches):
        memo = Memo(word_features)
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, max(b.num_rows, 1), ROWS)):
            texts = b.column(len(names) + 1).to_pylist()
            h = [hashed(t, memo).tobytes() for t in texts]
            f = [np.array(form_of(t)).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names) + 1)), pa.array(h, pa.binary()), pa.array(f, pa.binary())], names=["doc_id", *names, "words", "form"])

    schema = "doc_id long, " + ", ".join(f"{c} double" for c in names) + ", words binary, form binary"
    rows = stored(rows.mapInArrow(run, schema), "labelled-sample")

    def each(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int64))], names=["word"])

    common = rows.select("words").mapInArrow(each, "word long").groupBy("word").count().where(F.col("count") >= LEAST_DOCS).orderBy(F.desc("count"), "word").limit(VOCABULARY).select("word")
    known = np.sort(common.toArrow().column(0).to_numpy().view(np.uint64))

    def cut(batches):
        for b in batches:
            k = len(names) + 1
            docs = [np.frombuffer(w, np.uint64) for w in b.column(k).to_pylist()]
            places = [np.minimum(np.searchsorted(known, d), max(len(known) - 1, 0)) for d in docs]
            kept = [p[known[p] == d].astype("<i4").tobytes() if len(known) else b"" for p, d in zip(places, docs, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(k)), pa.array(kept, pa.binary()), b.column(k + 1)], names=b.schema.names)

    # Partition by partition: all at once, the driver's JVM would hold the sample several times.
    return sorted(rows.mapInArrow(cut, schema).toLocalIterator(), key=lambda r: (r.doc_id, bytes(r.words))), known


def fit_chain(documents: DataFrame, labels: DataFrame, names: list[str], most: int = SAMPLE) -> Chain:
    rows, vocabulary = labelled_sample(documents, labels, names, most)
    docs = [np.frombuffer(r.words, "<i4") for r in rows]
    form = np.array([np.frombuffer(bytes(r.form), np.float64) for r in rows]).reshape(len(rows), FORM)
    marks = {c: np.array([np.nan if r[c] is None else float(r[c]) for r in rows]) for c in names}
    chain = Chain.fit(np.array([r.doc_id for r in rows], np.int64), docs, form, marks, vocabulary)
    del rows, docs
    give_back()
    return chain


def classify(documents: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, out: str = "verdicts") -> DataFrame:
    """doc_id, p_<category> and a flag for each category, for every document.

    Null and empty texts have no words and are judged by the bias alone; null
    ids stay null; repeated rows get equal results. Other columns are left out,
    or with ``keep`` all columns stay and ``out`` (an array of flags) is added. Whole
    texts are read, however long.
    """
    names = chain.categories
    columns = documents.columns if keep else []

    def run(batches):
        memo = Memo(word_features)
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, max(b.num_rows, 1), ROWS)):
            at = b.schema.get_field_index(text_col) if keep else 1
            texts = b.column(at).to_pylist()
            docs = [hashed(t, memo) for t in texts]
            form = np.array([form_of(t) for t in texts]).reshape(len(texts), FORM)
            p = chain.predict(docs, form)
            flags = p > np.array(chain.thresholds)
            if keep:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(flags.tolist(), pa.list_(pa.bool_()))], names=[*columns, out])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.round(p[:, k], 6)) for k in range(len(names))), *(pa.array(flags[:, k]) for k in range(len(names)))], names=["doc_id", *(f"p_{c}" for c in names), *names])
        memo.clear()
        memo.old.clear()
        give_back()

    if keep:
        schema = documents.select("*", F.array(F.lit(True)).alias(out)).schema
        return documents.mapInArrow(run, schema)
    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in names) + ", " + ", ".join(f"{c} boolean" for c in names)
    return documents.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, schema)


def category_labels(labels: DataFrame) -> DataFrame:
    """The chain's categories from the table of labels: low_quality is 1 - quality."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    chain = fit_chain(documents, category_labels(table(spark, sf_dir, "labels")), list(CATEGORIES))
    return classify(documents, chain)
