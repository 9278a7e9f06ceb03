"""Sparse feature rows and a Hessian-free squared-hinge SVM over them.

A row is ``indices array<long>, values array<double>``: numeric columns first, then one slot per category of the
distributed dictionary, so a one-hot frame costs a row one entry per column whatever the vocabulary.  Zero and null
numbers and unseen or null categories have no entry.

``fit_sqhinge_sparse`` minimises the objective of ``linear.fit_sqhinge_l2`` (bias penalised) by truncated Newton: the
Newton system is solved by conjugate gradients, preconditioned with the diagonal, whose every step is one pass that
returns Hessian-vector products of all classes.  Memory is O(classes * features) on the driver and in a task; no
features-by-features matrix exists anywhere.
"""

from __future__ import annotations

from typing import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dictionary import with_codes
from .linear import STEPS, LinearSVMModel, _reported, _to_blob, class_costs, tree_sum


def assemble_sparse(df: DataFrame, keep: Sequence[str], numeric: Sequence[str], codes: DataFrame, sizes: dict[str, int]) -> tuple[DataFrame, int]:
    """(``keep``, indices, values) rows and the number of slots; ``codes, sizes`` come from ``category_codes``."""
    entries = [F.struct(F.lit(k).cast("long").alias("slot"), F.col(c).cast("double").alias("value")) for k, c in enumerate(numeric)]
    width = len(numeric)
    for c, size in sizes.items():
        code = F.col(f"{c}__code")
        entries.append(F.struct((code + width).cast("long").alias("slot"), F.when(code.isNotNull(), F.lit(1.0)).alias("value")))
        width += size
    there = F.filter(F.array(*entries), lambda e: e["value"].isNotNull() & (e["value"] != 0))
    rows = with_codes(df, codes, list(sizes)).select(*keep, there.alias("there"))
    return rows.select(*keep, F.col("there.slot").alias("indices"), F.col("there.value").alias("values")), width


class Block:
    """The rows of one Arrow batch as coordinate arrays, with products from both sides."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        lists = batch.column(batch.schema.get_field_index("indices"))
        offs = lists.offsets.to_numpy()
        self.n, self.width = len(lists), width
        self.row = np.repeat(np.arange(self.n), np.diff(offs))
        self.slot = lists.flatten().to_numpy(zero_copy_only=False)
        self.value = batch.column(batch.schema.get_field_index("values")).flatten().to_numpy(zero_copy_only=False)

    def times(self, W: np.ndarray) -> np.ndarray:
        """(class, row) values of weights (class, width + 1), whose last column is the bias."""
        return np.stack([np.bincount(self.row, self.value * w[self.slot], self.n) + w[-1] for w in W])

    def back(self, R: np.ndarray, square: bool = False) -> np.ndarray:
        """(class, width + 1) sums of the rows weighted by R; ``square`` squares the entries."""
        x = self.value ** 2 if square else self.value
        return np.stack([np.append(np.bincount(self.slot, x * r[self.row], self.width), r.sum()) for r in R])


def _summed(rows: DataFrame, width: int, label: str, fn: Callable) -> np.ndarray | None:
    def run(batches):
        acc = None
        for b in batches:
            if b.num_rows:
                part = fn(Block(b, width), b.column(b.schema.get_field_index(label)).to_numpy(zero_copy_only=False))
                acc = part if acc is None else acc + part
        if acc is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_to_blob(acc)], pa.binary())], names=["blob"])
    return tree_sum(rows.select("indices", "values", label).mapInArrow(run, "blob binary"))


def fit_sqhinge_sparse(rows: DataFrame, width: int, classes: Sequence[int], C: float = 1.0, class_weight: Sequence[float] | None = None,
                       tol: float = 1e-3, max_iter: int = 1000, max_cg: int = 200, label: str = "label") -> LinearSVMModel:
    """One-vs-rest squared-hinge SVM; ``rows`` should be persisted.  A gradient below ``tol`` of the first one is the
    end; ``converged`` tells whether every class got there.  An empty table gives weights of zero."""
    classes = np.asarray(list(classes))
    costs, k, d = class_costs(classes, C, class_weight), len(classes), width + 1

    def sides(y):
        return np.where(y[None, :] == classes[:, None], 1.0, -1.0), costs[:, np.searchsorted(classes, y)]

    def gradient(W):
        def fn(x, y):
            s, c = sides(y)
            m = x.times(W)
            v = np.maximum(0.0, 1.0 - s * m)
            return np.concatenate([(c * v * v).sum(axis=1), (2 * x.back(-c * s * v)).ravel(), (2 * x.back(c * (v > 0), True)).ravel()])
        got = _summed(rows, width, label, fn)
        got = np.zeros(k + 2 * k * d) if got is None else got
        return got[:k] + 0.5 * (W ** 2).sum(axis=1), got[k:k + k * d].reshape(k, d) + W, got[k + k * d:].reshape(k, d) + 1.0

    def curvature(W, V):
        def fn(x, y):
            s, c = sides(y)
            return 2 * x.back(c * (s * x.times(W) < 1.0) * x.times(V))
        got = _summed(rows, width, label, fn)
        return V + (0.0 if got is None else got)

    def along(W, D):
        """Objective by (class, step length) in one pass."""
        def fn(x, y):
            s, c = sides(y)
            m, u = x.times(W), x.times(D)
            return np.stack([(c * np.maximum(0.0, 1.0 - s * (m + t * u)) ** 2).sum(axis=1) for t in STEPS], axis=1)
        got = _summed(rows, width, label, fn)
        return (0.0 if got is None else got) + 0.5 * np.stack([((W + t * D) ** 2).sum(axis=1) for t in STEPS], axis=1)

    def direction(W, g, diag, todo):
        """Conjugate gradients on the Newton systems of all classes side by side, each to its own tolerance."""
        D, r = np.zeros((k, d)), np.where(todo[:, None], -g, 0.0)
        first = np.linalg.norm(r, axis=1)
        goal = first * np.minimum(0.1, np.sqrt(first / np.maximum(g0, 1e-300)))
        z = r / diag
        p, rz = z.copy(), (r * z).sum(axis=1)
        for _ in range(max_cg):
            on = np.linalg.norm(r, axis=1) > goal
            if not on.any():
                break
            Hp = curvature(W, np.where(on[:, None], p, 0.0))
            a = np.where(on, rz / np.maximum((p * Hp).sum(axis=1), 1e-300), 0.0)[:, None]
            D, r = D + a * p, r - a * Hp * on[:, None]
            z = r / diag
            new = (r * z).sum(axis=1)
            p, rz = np.where(on[:, None], z + (new / np.maximum(rz, 1e-300))[:, None] * p, p), np.where(on, new, rz)
        return D

    W, history = np.zeros((k, d)), []
    f, g, diag = gradient(W)
    g0 = np.linalg.norm(g, axis=1)
    stalled = np.zeros(k, bool)
    for _ in range(max_iter):
        history.append(float(f.sum()))
        todo = (np.linalg.norm(g, axis=1) > tol * g0) & ~stalled
        if not todo.any():
            break
        D = direction(W, g, diag, todo)
        enough = along(W, D) <= f[:, None] + 0.01 * np.array(STEPS)[None, :] * (g * D).sum(axis=1)[:, None]
        stalled |= todo & ~enough.any(axis=1)
        step = np.where(todo & enough.any(axis=1), np.array(STEPS)[np.argmax(enough, axis=1)], 0.0)
        W = W + step[:, None] * D
        f, g, diag = gradient(W)
    return _reported(LinearSVMModel(W, classes.tolist(), history, bool((np.linalg.norm(g, axis=1) <= tol * g0).all())), max_iter)


def score_sparse(rows: DataFrame, model: LinearSVMModel, keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """(``keep``, prediction): the class of the largest decision value, the first on ties."""
    W, classes, keep = model.W, np.asarray(model.classes, np.int32), list(keep)

    def run(batches):
        for b in batches:
            best = np.argmax(Block(b, W.shape[1] - 1).times(W), axis=0)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array(classes[best])], names=[*keep, "prediction"])
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", prediction int"
    return rows.select(*keep, "indices", "values").mapInArrow(run, schema)
