"""Toxicity by a classifier chain.

Categories are predicted one after another.  The model of a category is a
logistic regression over the words of a text (their counts) and the
probabilities of the categories before it.  For training these probabilities are
out-of-fold: each fold's are given by a model of the other folds, so a later model
learns from errors like those it will meet.  Scoring runs the models fitted on all
training rows along the chain.

Training takes at most ``max_train`` labelled rows, chosen by hash of doc_id
(a documented bound; every fold is fitted in a task of its own).  Words and their stems
(first bytes, for languages that build words by endings) are known by a 64-bit hash of their letters, without marks around them and in lower case
(A-Z); words of fewer than ``min_docs`` training texts are left out, so the model
is bounded by the training rows.  All documents are scored over their whole texts.

Defined results: null and empty texts are scored by the intercepts; documents
without a label are scored like others; several labels of one document count each;
without any labelled row all probabilities are null and nothing is flagged; an
empty table gives an empty result.  Extra columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .textops import LOWER, flat, mix, slices, span_hash, text_slices

# category -> labelled rows that have it, in the order of the chain
CATEGORIES: tuple[tuple[str, str], ...] = (
    ("toxic", "toxic = 1"),
    ("toxic_prose", "toxic = 1 AND quality = 1"),
    ("toxic_junk", "toxic = 1 AND quality = 0"),
)
MAX_TRAIN = 5000
MIN_DOCS = 3
FOLDS = 5
L2 = 0.1
STEMS = (4, 5, 6, 7, 8)
THRESHOLD = 0.25

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, value) of the distinct words of all rows and of their stems, the first ``STEMS``
    bytes of longer words; the value is log2(1 + occurrences)."""
    w = _LETTER[data]
    if not w.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.float32)
    first = np.zeros(len(w) + 1, bool)
    first[offs] = True
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1] | first[1:len(w)]
    end[:-1] &= ~w[1:] | first[1:len(w)]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    row, low = np.searchsorted(offs, s, "right") - 1, LOWER[data]
    rows, hashes = [row], [span_hash(low, s, e)]
    for k in STEMS:
        longer = np.flatnonzero(e - s > k)
        rows.append(row[longer])
        hashes.append(mix(span_hash(low, s[longer], s[longer] + k) + np.uint64(k)))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    return row[start], h[start], np.log2(1.0 + np.diff(np.append(start, len(h)))).astype(np.float32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(row: np.ndarray, col: np.ndarray, val: np.ndarray, n_cols: int, dense: np.ndarray, y: np.ndarray, l2: float = L2, steps: int = 200, tol: float = 1e-4) -> np.ndarray:
    """Weights (columns, dense columns, intercept) of an L2-penalised logistic regression, by L-BFGS.

    The intercept is not penalised.  Raises if the gradient does not come below ``tol`` per row.
    """
    n, k = len(y), dense.shape[1]

    def value(w):
        z = np.bincount(row, weights=w[col] * val, minlength=n) + dense @ w[n_cols:n_cols + k] + w[-1]
        pen = w.copy()
        pen[-1] = 0
        loss = np.logaddexp(0, z) - y * z
        r = sigmoid(z) - y
        grad = np.concatenate([np.bincount(col, weights=r[row] * val, minlength=n_cols), dense.T @ r, [r.sum()]]) + l2 * pen
        return loss.sum() + 0.5 * l2 * pen @ pen, grad

    w = np.zeros(n_cols + k + 1)
    f, g = value(w)
    old: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(g).max() <= tol * max(1, n):
            return w
        d, alphas = g.copy(), []
        for s, t, rho in reversed(old):
            alphas.append(rho * s @ d)
            d -= alphas[-1] * t
        if old:
            s, t, _ = old[-1]
            d *= (s @ t) / (t @ t)
        for (s, t, rho), a in zip(old, reversed(alphas)):
            d += (a - rho * t @ d) * s
        step, slope = (1.0 if old else min(1.0, 1.0 / np.abs(g).sum())), g @ d
        while True:
            f2, g2 = value(w - step * d)
            if f2 <= f - 1e-4 * step * slope or step < 1e-12:
                break
            step *= 0.5
        s, t = -step * d, g2 - g
        if s @ t > 1e-12:
            old = (old + [(s, t, 1.0 / (s @ t))])[-10:]
        w, f, g = w - step * d, f2, g2
    raise ArithmeticError(f"logistic regression did not converge in {steps} steps")


def _train(min_docs: int, l2: float):
    """Fits one category for one fold: rows outside the fold train, rows inside are predicted (fold -1: all rows)."""
    def run(key, table):
        part = key[0].as_py()
        fold = table.column("fold").to_numpy()
        y = table.column("y").to_numpy().astype(float)
        before = np.array(table.column("before").to_pylist(), float).reshape(len(y), -1)
        data, offs = flat(table.column("text"))
        got = [(i, *features(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])) for i, j in slices(offs)]
        row, h, v = np.concatenate([g[1] + g[0] for g in got]), np.concatenate([g[2] for g in got]), np.concatenate([g[3] for g in got])
        use = fold != part
        vocab, n = np.unique(h[use[row]], return_counts=True)
        vocab = vocab[n >= min_docs]
        at = np.searchsorted(vocab, h)
        at[at == len(vocab)] = 0
        known = vocab[at] == h if len(vocab) else np.zeros(len(h), bool)
        row, at, v = row[known], at[known], v[known].astype(float)
        number = np.cumsum(use) - 1
        m = use[row]
        w = fit_logistic(number[row[m]], at[m], v[m], len(vocab), before[use], y[use], l2)
        if part < 0:
            return pa.table({"i": pa.array([None], pa.int64()), "p": pa.array([None], pa.float64()), "vocab": pa.array([vocab.astype("<u8").tobytes()], pa.binary()),
                             "weights": pa.array([w.astype("<f8").tobytes()], pa.binary())})
        z = np.bincount(row, weights=w[at] * v, minlength=len(y)) + before @ w[len(vocab):-1] + w[-1]
        held = np.flatnonzero(~use)
        return pa.table({"i": table.column("i").take(pa.array(held)), "p": pa.array(sigmoid(z[held])), "vocab": pa.nulls(len(held), pa.binary()), "weights": pa.nulls(len(held), pa.binary())})
    return run


def fit_chain(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, max_train: int = MAX_TRAIN, min_docs: int = MIN_DOCS, folds: int = FOLDS,
              l2: float = L2, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """(vocabulary, weights) of each category, in chain order; empty without labelled rows."""
    names = [c for c, _ in categories]
    picked = labels.filter("doc_id is not null").select("doc_id", *[F.coalesce(F.expr(e), F.lit(False)).cast("double").alias(f"y_{c}") for c, e in categories]) \
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", *[f"y_{c}" for c in names]).limit(max_train)
    # at most max_train rows of two numbers and the flags: small enough to broadcast whatever the corpus
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(folds))) \
        .withColumn("i", F.xxhash64("doc_id", "text", *[f"y_{c}" for c in names]))
    rows = cut_lineage(rows.dropDuplicates(["i"]))
    if rows.isEmpty():
        return []
    models, before = [], F.array().cast("array<double>")
    for c in names:
        data = rows.select("i", "fold", "text", F.col(f"y_{c}").alias("y"), before.alias("before"))
        tasks = data.withColumn("part", F.explode(F.array(*[F.lit(k).cast("long") for k in range(-1, folds)])))
        got = cut_lineage(tasks.groupBy("part").applyInArrow(_train(min_docs, l2), "i long, p double, vocab binary, weights binary"))
        full = got.filter("weights is not null").first()       # one row, bounded by the training rows
        models.append((np.frombuffer(full["vocab"], "<u8"), np.frombuffer(full["weights"], "<f8")))
        rows = cut_lineage(rows.join(got.filter("weights is null").select("i", F.col("p").alias(f"p_{c}")), "i"))
        before = F.array(*[F.col(f"p_{x}") for x in names[:len(models)]])
    return models


def score_chain(docs: DataFrame, models, categories=CATEGORIES, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, one probability per category, ``flagged`` (the first category reaches the threshold)."""
    names = [c for c, _ in categories]
    schema = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(f"p_{c}", T.DoubleType()) for c in names])
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not models:
        return src.select("doc_id", *[F.lit(None).cast("double").alias(f"p_{c}") for c in names], F.lit(False).alias("flagged"))

    def run(batches):
        for rows, data, offs in text_slices(batches, "text"):
            row, h, v = features(data, offs)
            n, before = len(offs) - 1, []
            for vocab, w in models:
                at = np.minimum(np.searchsorted(vocab, h), max(0, len(vocab) - 1))
                known = vocab[at] == h if len(vocab) else np.zeros(len(h), bool)
                z = np.bincount(row[known], weights=w[at[known]] * v[known], minlength=n) + w[-1]
                for k, p in enumerate(before):
                    z = z + p * w[len(vocab) + k]
                before.append(sigmoid(z))
            yield pa.RecordBatch.from_arrays([rows.column(0)] + [pa.array(p) for p in before], names=schema.names)

    return src.mapInArrow(run, schema).withColumn("flagged", F.col(f"p_{names[0]}") >= threshold)


def op8_toxicity_chain(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_chain(docs, fit_chain(docs, labels))
    return scored.select("doc_id", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c, _ in CATEGORIES], F.col("flagged").alias("toxic"))


QUERIES = {"op8_toxicity_chain": (op8_toxicity_chain, None)}
