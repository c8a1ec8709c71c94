"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams, so a misspelling never seen shares most of its n-grams
with the word it stands for.  A window of words is the mean of its words, and a linear softmax over two classes (a
logistic unit on the difference) scores it.  A word that repeats in a window counts once, its further places nothing,
so a run of one harmless word is not read as loudly as an insult.  A document is as toxic as its most toxic window, so an insult weighs the
same in a long text as in a short one.  Vectors and classifier are trained together: first every window of a document
carries the document's label, then only the window that decides it, then scale and offset are fitted to the labels.

Training reads a bounded sample of labelled rows on the driver (at most ``max_docs`` rows and ``max_chars`` characters
in all); scoring reads every whole text in one narrow pass.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\W_]+")
BUCKETS, DIM, WINDOW = 1 << 17, 8, 12
GRAMS = (3, 4, 5)
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits that hold a letter."""
    return [w for w in WORDS.findall(text.lower()) if not w.isdigit()]


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Bucket of each character n-gram of each word with its edges marked, the word it is of, and the number of words."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    code = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.cumsum(code == ord("<")) - 1
    buckets, owners, rolled = [], [], code.copy()
    for n in range(2, max(GRAMS) + 1):
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + code[n - 1 :] if len(rolled) > 1 else rolled[:0]
        if n in GRAMS:
            inside = np.flatnonzero(word[: len(rolled)] == word[n - 1 :][: len(rolled)])
            mixed = (rolled[inside] + np.uint64(n)) * MIX
            buckets.append((mixed >> np.uint64(64 - 17)).astype(np.int64))
            owners.append(word[inside])
    return np.concatenate(buckets), np.concatenate(owners), len(words)


def repeats(words: list[str], within: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that also stand less than so many places before, and the last such place of each."""
    known: dict[str, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words])
    order = np.argsort(ids, kind="stable")
    again = (ids[order][1:] == ids[order][:-1]) & (order[1:] - order[:-1] < within)
    return order[1:][again], order[:-1][again]


@dataclass
class Model:
    """Weight of each n-gram bucket (its vector times the classifier), offset, final scale and offset, score of no words."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float
    empty: float
    window: int = WINDOW

    def logit(self, text: str) -> float | None:
        words = words_of(text)
        bucket, word, n_words = grams_of(words)
        if not n_words:
            return None
        s = np.bincount(word, weights=self.weights[bucket], minlength=n_words) / np.bincount(word, minlength=n_words)
        n = min(self.window, n_words)
        c = np.concatenate([[0.0], np.cumsum(s)])
        # A repeat counts nothing in the windows that hold its earlier place too.
        at, before = repeats(words, n)
        size = n_words - n + 2
        twice = np.bincount(np.maximum(0, at - n + 1), s[at], size) - np.bincount(np.minimum(before, n_words - n) + 1, s[at], size)
        return self.bias + float((c[n:] - c[:-n] - np.cumsum(twice)[:-1]).max()) / n

    def score(self, text: str) -> float:
        x = self.logit(text)
        return self.empty if x is None else 1 / (1 + math.exp(-max(-500.0, min(500.0, self.scale * x + self.shift))))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(texts: list[str], labels: list[int], share: float | None = None, seed: int = 7, warm: int = 40, steps: int = 100, rate: float = 0.05) -> Model:
    """share: of ones among all rows, where the sample's own differs; it sets the final offset.

    With labels of one class only, or none, the model answers the share of ones (a half of no labels).
    """
    y = np.asarray(labels, np.float64)
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    share = prior if share is None else min(max(share, 1e-4), 1 - 1e-4)
    flat = Model(np.zeros(BUCKETS), 0.0, 0.0, math.log(share / (1 - share)), share)
    if len(set(labels)) < 2:
        return flat
    ids: dict[str, int] = {}
    occ, counts, sizes, docs = [], [], [], []
    for d, text in enumerate(texts):
        own = [ids.setdefault(w, len(ids)) for w in words_of(text)]
        for i in range(0, max(1, len(own) - WINDOW // 2), WINDOW // 2):
            if piece := own[i : i + WINDOW]:
                distinct = list(dict.fromkeys(piece))
                occ.append(np.array(distinct, np.int32))
                counts.append(len(distinct))
                sizes.append(len(piece))
                docs.append(d)
    if not occ:
        return flat
    gram, word_of, n_words = grams_of(list(ids))
    if n_words != len(ids):
        raise AssertionError("a word of the sample splits in two")
    n_grams = np.bincount(word_of, minlength=n_words)
    occ_, sizes_, docs_ = np.concatenate(occ), np.array(sizes), np.array(docs)
    del occ
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    window_of = np.repeat(np.arange(len(sizes_)), counts)
    seen, doc_first = np.unique(docs_, return_index=True)
    per_doc = np.diff(np.append(doc_first, len(docs_)))
    y_doc, y_window = y[seen], y[docs_]

    def balance(of: np.ndarray) -> np.ndarray:
        return np.where(of == 1, 0.5 / max(1.0, of.sum()), 0.5 / max(1.0, len(of) - of.sum()))

    rng = np.random.default_rng(seed)
    p = {"e": rng.uniform(-0.5 / DIM, 0.5 / DIM, (BUCKETS, DIM)), "w": rng.uniform(-1, 1, DIM), "b": np.zeros(1)}
    mean, var = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for t in range(1, warm + steps + 1):
        # All means are linear, so the classifier may be applied to the n-gram vectors first.
        by_bucket = p["e"] @ p["w"]
        word = np.bincount(word_of, weights=by_bucket[gram], minlength=n_words) / n_grams
        logit = np.add.reduceat(word[occ_], first) / sizes_ + p["b"][0]
        if t <= warm:
            g = (sigmoid(logit) - y_window) * balance(y_window)
        else:
            top = np.maximum.reduceat(logit, doc_first)
            decides = np.flatnonzero(logit == np.repeat(top, per_doc))
            decides = decides[np.unique(docs_[decides], return_index=True)[1]]
            g = np.zeros(len(logit))
            g[decides] = (sigmoid(logit[decides]) - y_doc) * balance(y_doc)
        by_word = np.bincount(occ_, weights=(g / sizes_)[window_of], minlength=n_words)
        by_gram = np.bincount(gram, weights=(by_word / n_grams)[word_of], minlength=BUCKETS)
        grad = {"e": by_gram[:, None] * p["w"], "w": p["e"].T @ by_gram, "b": np.array([g.sum()])}
        for k in p:
            mean[k] = 0.9 * mean[k] + 0.1 * grad[k]
            var[k] = 0.99 * var[k] + 0.01 * grad[k] ** 2
            p[k] -= rate * (mean[k] / (1 - 0.9**t)) / (np.sqrt(var[k] / (1 - 0.99**t)) + 1e-7)
    model = Model(p["e"] @ p["w"], float(p["b"][0]), 1.0, 0.0, share)
    x = np.array([-60.0 if (v := model.logit(t)) is None else max(-60.0, min(60.0, v)) for t in texts])
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum()))
    a, b = 1.0, 0.0
    for _ in range(500):
        e = (sigmoid(a * x + b) - y) * weight
        a, b = a - 0.05 * ((e * x).sum() + 1e-3 * (a - 1)), b - 0.2 * e.sum()
    model.scale, model.shift = max(a, 0.05), b
    model.empty = float(sigmoid(model.scale * x[y == 0] + b).mean())
    return model


def in_training(doc_id: Column | str) -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % 5 != 0


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, max_docs: int, max_chars: int) -> tuple[list[tuple[str, int]], float]:
    """At most max_docs rows of the training folds, a quarter of them ones, first by hash of doc_id, of any length; and
    the share of ones.  A row beyond max_chars characters in all is left out."""
    own = labels.where(F.col(label).isin(0, 1) & in_training("doc_id")).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    n, ones = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("_y"), F.lit(0))).first()
    text = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    zeros, few = (own.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(k) for y, k in ((0, max_docs - max_docs // 4), (1, max_docs // 4)))
    # At most max_docs ids, so the broadcast is bounded.
    rows = text.join(F.broadcast(zeros.union(few)), F.col("doc_id") == F.col("_id")).select("text", "_y", F.xxhash64("doc_id").alias("_h"), "doc_id")
    rows = rows.orderBy("_h", "doc_id", "text").limit(max_docs)
    so_far = F.sum(F.length("text")).over(Window.orderBy("_h", "doc_id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = rows.withColumn("_sum", so_far).where(F.col("_sum") <= max_chars).select("text", "_y").collect()
    return [(r[0], r[1]) for r in found], (ones / n if n else 0.5)


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = 2400, max_chars: int = 24_000_000) -> Model:
    """The sample is bounded by max_docs rows and max_chars characters in all; labels that are null or neither 0 nor 1 are left out."""
    rows, share = sample_labelled(docs, labels, "toxic", max_docs, max_chars)
    return train([t for t, _ in rows], [y for _, y in rows], share)


def score_toxicity(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """The given columns (doc_id if none), score and predicted of every row.

    Null and empty texts and texts without a word get the score of no words; very long texts are read whole.  Repeated
    rows get equal scores, and ties do not arise.  An empty table gives an empty table.  Other columns than those given
    and text are not read, so they may have any name; a given one named score or predicted comes back as carried_<name>.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.weights.tobytes(), model.bias, model.scale, model.shift, model.empty, model.window))
    columns = list(columns or ["doc_id"])
    names = [f"c{i}" for i in range(len(columns))]
    rows = docs.select(*[F.col(c).alias(x) for c, x in zip(columns, names)], F.col("text").cast("string").alias("t"))

    def run(batches: Iterator) -> Iterator:
        raw, *rest = sent.value
        score = Model(np.frombuffer(raw), *rest).score
        for batch in batches:
            s = pa.array([score(t.as_py() or "") for t in batch.column(len(names))], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], s], names=[*names, "s"])

    out = rows.mapInArrow(run, rows.select(*names, F.lit(0.0).alias("s")).schema)
    back = [F.col(x).alias(f"carried_{c}" if c in ("score", "predicted") else c) for c, x in zip(columns, names)]
    return out.select(*back, F.col("s").alias("score"), (F.col("s") >= 0.5).cast("int").alias("predicted"))
