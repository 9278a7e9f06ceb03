"""Distributed one-vs-rest linear SVM (squared hinge, L2 or L1) and linear scoring.

Spark ML's ``LinearSVC`` is binary and hinge-only, so the squared-hinge model
is fitted here by a generalized Newton method whose every iteration is ONE
Spark job over cached blocks of rows:

* the feature rows are packed once into blocks (0/1 columns as bits), so that a
  pass reads arrays and converts no rows;
* each partition computes, for all classes at once, the partial objective and
  gradient with numpy, and what the generalized Hessian changes by: only rows
  that entered or left the margin since the last point add to it.  At w = 0 every row
  is inside, and one matrix per label serves all problems;
* partials are summed in a tree of tasks, so the driver receives few small
  arrays, never rows;
* the d x d Newton system is solved on the driver (d = feature count).

The objective per class k (liblinear's primal L2-loss SVM, bias appended as a
constant feature and penalised):
    f(w) = 0.5 |w|^2 + sum_i C_i max(0, 1 - y_i w.x_i)^2
with C_i = C * class_weight[k] on positives and C on negatives.
A pass evaluates the full step together with the next gradient, so an accepted full
step costs no extra job; shorter ones are evaluated only for a refused step.
"""

from __future__ import annotations

import io
import warnings
from dataclasses import dataclass, field
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = (1.0, 0.5, 0.25, 0.125, 0.0625, 0.03125)
FANIN = 32                 # partial sums that reach the driver at once
DRIVER_BYTES = 16 << 20    # and their bytes
BLOCK_BYTES = 8 << 20      # of a block's rows as doubles
SLICE_BYTES = 16 << 20     # of partial sums that a task adds up


def _to_blob(a: np.ndarray) -> bytes:
    buf = io.BytesIO()
    np.save(buf, a, allow_pickle=False)
    return buf.getvalue()


def _from_blob(b: bytes) -> np.ndarray:
    return np.load(io.BytesIO(b), allow_pickle=False)


def tree_sum(parts: DataFrame, fanin: int = 16) -> np.ndarray | None:
    """Sum the numpy arrays held in ``parts.blob`` with one intermediate level
    of ``fanin`` tasks; the driver receives at most ``fanin`` arrays."""
    def merge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = None
        for pdf in it:
            for b in pdf["blob"]:
                a = _from_blob(b)
                acc = a if acc is None else acc + a
        if acc is not None:
            yield pd.DataFrame({"blob": [_to_blob(acc)]})
    # one intermediate level only when there are more partials than fanin
    mid = parts.repartition(fanin).mapInPandas(merge, "blob binary") \
        if parts.rdd.getNumPartitions() > fanin else parts
    total = None
    for r in mid.collect():
        a = _from_blob(r["blob"])
        total = a if total is None else total + a
    return total


def _partials(df: DataFrame, feat: str, label: str, weight: str | None, fn) -> DataFrame:
    cols = [feat, label] + ([weight] if weight else [])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = None
        for pdf in it:
            if len(pdf) == 0:
                continue
            X = np.vstack(pdf[feat].to_numpy()).astype(np.float64)
            y = pdf[label].to_numpy()
            sw = pdf[weight].to_numpy(dtype=np.float64) if weight else None
            part = fn(X, y, sw)
            acc = part if acc is None else acc + part
        if acc is not None:
            yield pd.DataFrame({"blob": [_to_blob(acc)]})
    return df.select(*cols).mapInPandas(run, "blob binary")


@dataclass
class LinearSVMModel:
    """W: (k, d+1) weights, last column = bias (feature value 1)."""
    W: np.ndarray
    classes: list[int]
    history: list[float] = field(default_factory=list)
    converged: bool = True

    def decision_columns(self, feat: str = "features") -> list:
        """One decision value per class as a native expression (no UDF):
        aggregate(zip_with(features, w)) + bias."""
        out = []
        for k, _ in enumerate(self.classes):
            w = F.array(*[F.lit(float(v)) for v in self.W[k, :-1]])
            dot = F.aggregate(F.zip_with(F.col(feat), w, lambda a, b: a * b), F.lit(0.0),
                              lambda acc, v: acc + v)
            out.append(dot + F.lit(float(self.W[k, -1])))
        return out

    def transform(self, df: DataFrame, feat: str = "features", out: str = "prediction") -> DataFrame:
        dec = F.array(*self.decision_columns(feat))
        idx = (F.array_position(dec, F.array_max(dec)) - 1).cast("int")
        cls = F.element_at(F.array(*[F.lit(c) for c in self.classes]), idx + 1)
        return df.withColumn("decision", dec).withColumn(out, cls.cast("int"))


def _sqhinge_stats(W: np.ndarray, classes, C: np.ndarray, Cneg: float, with_hess: bool,
                   steps: tuple = (), D: np.ndarray | None = None, with_grad: bool | None = None):
    """Returns fn(X, y, sw) -> flat array
    [f (k), g (k*d) if with_grad, H (k*d*d) if with_hess, f_steps (k*len(steps))]."""
    with_grad = with_hess if with_grad is None else with_grad
    k, d = W.shape

    def fn(X, y, sw):
        Xb = np.hstack([X, np.ones((X.shape[0], 1))])
        out = []
        fs, gs, hs, fst = [], [], [], []
        for j, c in enumerate(classes):
            yy = np.where(y == c, 1.0, -1.0)
            ci = np.where(yy > 0, C[j], Cneg)
            if sw is not None:
                ci = ci * sw
            m = Xb @ W[j]
            viol = 1.0 - yy * m
            act = viol > 0
            fs.append(np.sum(ci[act] * viol[act] ** 2))
            if with_grad:
                r = ci[act] * (m[act] - yy[act])
                gs.append(2.0 * Xb[act].T @ r)
            if with_hess:
                Xa = Xb[act] * np.sqrt(ci[act])[:, None]
                hs.append(2.0 * Xa.T @ Xa)
            for s in steps:
                ms = Xb @ (W[j] + s * D[j])
                v = 1.0 - yy * ms
                a = v > 0
                fst.append(np.sum(ci[a] * v[a] ** 2))
        out = [np.array(fs)]
        if with_grad:
            out.append(np.concatenate(gs))
        if with_hess:
            out.append(np.concatenate([h.ravel() for h in hs]))
        if steps:
            out.append(np.array(fst))
        return np.concatenate(out)
    return fn


def loss_grad_at(df: DataFrame, W: np.ndarray, classes: Sequence[int], C: float,
                 class_weight: Sequence[float] | None = None, feat: str = "features",
                 label: str = "label", weight: str | None = None):
    """Objective and gradient of every class at fixed W (one job)."""
    k, d = W.shape
    cw = np.asarray(class_weight if class_weight is not None else [1.0] * k) * C
    fn = _sqhinge_stats(W, list(classes), cw, C, True)
    tot = tree_sum(_partials(df, feat, label, weight, fn))
    f = tot[:k] + 0.5 * np.sum(W ** 2, axis=1)
    g = tot[k:k + k * d].reshape(k, d) + W
    return f, g


def class_costs(classes: Sequence[int], C: float, class_weight: Sequence[float] | None = None) -> np.ndarray:
    """(problem, label) costs: a class weight raises the class's own side of its problem only."""
    k = len(classes)
    own = np.asarray(class_weight if class_weight is not None else [1.0] * k, dtype=float)
    return C * np.where(np.eye(k, dtype=bool), own[:, None], 1.0)


def row_costs(classes: Sequence[int], C: float, label_weight: Sequence[float]) -> np.ndarray:
    """(problem, label) costs of row weights: a row's label weighs in all problems."""
    return C * np.tile(np.asarray(label_weight, dtype=float), (len(classes), 1))


@dataclass
class _Block:
    """Some rows: their columns of zeros and ones as bits, the others as doubles."""
    n: int
    is_bit: np.ndarray
    bits: np.ndarray
    rest: np.ndarray
    label: np.ndarray
    weight: np.ndarray | None

    def x(self) -> np.ndarray:
        """Features and the bias column."""
        out = np.ones((self.n, len(self.is_bit) + 1))
        at = np.flatnonzero(self.is_bit)
        out[:, at] = np.unpackbits(self.bits, axis=1, count=len(at))
        out[:, np.flatnonzero(~self.is_bit)] = self.rest
        return out


def packed(df: DataFrame, feat: str, label: str, weight: str | None) -> RDD:
    """The rows of ``df`` as an RDD of ``_Block``: an Arrow batch, or a part of it where its rows are wide."""
    cols = [F.col(feat), F.col(label).cast("double").alias("label")] + ([F.col(weight).cast("double").alias("weight")] if weight else [])

    def parts(batches):
        for b in batches:
            if b.num_rows:
                width = len(b.column(0).flatten()) // b.num_rows
                step = max(1, BLOCK_BYTES // (8 * max(1, width)))
                yield from (b.slice(at, step) for at in range(0, b.num_rows, step))

    def pack(batches):
        for b in parts(batches):
            n = b.num_rows
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            is_bit = ((x == 0) | (x == 1)).all(axis=0)
            blobs = [is_bit.tobytes(), np.packbits(x[:, is_bit].astype(bool), axis=1).tobytes(), x[:, ~is_bit].tobytes(),
                     *[c.to_numpy(zero_copy_only=False).astype(float).tobytes() for c in b.columns[1:]]]
            names = ["is_bit", "bits", "rest", "label", "weight"][:len(blobs)]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *[pa.array([v], pa.binary()) for v in blobs]], names=["n", *names])

    def block(r) -> _Block:
        is_bit = np.frombuffer(r["is_bit"], bool)
        return _Block(r["n"], is_bit, np.frombuffer(r["bits"], np.uint8).reshape(r["n"], -1), np.frombuffer(r["rest"], float).reshape(r["n"], -1),
                      np.frombuffer(r["label"], float), np.frombuffer(r["weight"], float) if weight else None)
    schema = "n int, is_bit binary, bits binary, rest binary, label binary" + (", weight binary" if weight else "")
    return df.select(*cols).mapInArrow(pack, schema).rdd.map(block)


def _block_sum(blocks: RDD, fn, size: int) -> np.ndarray | None:
    """Sum of ``fn(block)``, an array of ``size`` numbers, over all blocks in the order of their partitions; None without
    blocks.  The driver gets all partitions' sums while they are few and small, else their total in slices: tasks
    add up a slice each."""
    def part(it):
        acc = None
        for b in it:
            v = fn(b)
            acc = v if acc is None else acc + v
        if acc is not None:
            yield acc
    parts = blocks.mapPartitions(part)
    n = parts.getNumPartitions()
    if n > FANIN or 8 * size * n > DRIVER_BYTES:
        slices = max(1, min(n, 8 * size * n // SLICE_BYTES))

        def cut(i, it):
            for v in it:
                for k, piece in enumerate(np.array_split(v.ravel(), slices)):
                    yield k, (i, piece)

        def added(pieces):
            total = None
            for _, v in sorted(pieces, key=lambda p: p[0]):
                total = v if total is None else total + v
            return total
        found = dict(parts.mapPartitionsWithIndex(cut).groupByKey(slices).mapValues(added).collect())
        return np.concatenate([found[k] for k in range(slices)]) if found else None
    total = None
    for v in parts.collect():
        total = v.ravel() if total is None else total + v.ravel()
    return total


def _upper(h: np.ndarray) -> np.ndarray:
    """The upper triangles of symmetric matrices (..., d, d)."""
    return h[..., *np.triu_indices(h.shape[-1])]


def _square(upper: np.ndarray, d: int) -> np.ndarray:
    out = np.empty((*upper.shape[:-1], d, d))
    i, j = np.triu_indices(d)
    out[..., i, j] = upper
    out[..., j, i] = upper
    return out


class _Passes:
    """Objective, gradient and Hessian of the data term of many problems (candidate, class) over cached blocks.
    ``costs`` is (candidate, class, label)."""

    def __init__(self, df: DataFrame, classes: np.ndarray, costs: np.ndarray, d: int, feat: str, label: str, weight: str | None):
        self.blocks = packed(df, feat, label, weight).persist(StorageLevel.MEMORY_AND_DISK)
        self.classes, self.costs, self.d = classes, costs, d

    def release(self) -> None:
        self.blocks.unpersist()

    def at_zero(self):
        """(f, g, H) of every problem at w = 0, from one matrix per label."""
        classes, costs, d = self.classes, self.costs, self.d

        def fn(b: _Block):
            x = b.x()
            out = np.zeros((len(classes), d, d))
            for t, c in enumerate(classes):
                rows = b.label == c
                xr = x[rows] if b.weight is None else x[rows] * np.sqrt(b.weight[rows])[:, None]
                out[t] = xr.T @ xr
            return _upper(out)
        sums = _block_sum(self.blocks, fn, len(classes) * d * (d + 1) // 2)
        grams = np.zeros((len(classes), d, d)) if sums is None else _square(sums.reshape(len(classes), -1), d)
        side = 2.0 * np.eye(len(classes)) - 1.0                       # (class, label): y of the label's rows
        f = costs @ grams[:, -1, -1]
        g = -2.0 * np.einsum("qjl,jl,ld->qjd", costs, side, grams[:, -1, :])
        return f, g, 2.0 * np.einsum("qjl,lde->qjde", costs, grams)

    def at(self, W: np.ndarray, known: np.ndarray, H: np.ndarray, todo: np.ndarray):
        """(f, g, H) at ``W`` of the problems ``todo``; ``H`` is the Hessian at ``known``."""
        classes, costs, d, ix = self.classes, self.costs, self.d, tuple(todo.T)
        now, before, n = W[ix], known[ix], len(todo)

        def fn(b: _Block):
            x = b.x()
            at = np.searchsorted(classes, b.label)
            m_now, m_before = x @ now.T, x @ before.T
            fs, gs, hs = np.zeros(n), np.zeros((n, d)), np.zeros((n, d, d))
            for t, (q, j) in enumerate(todo):
                yy = np.where(b.label == classes[j], 1.0, -1.0)
                ci = costs[q, j][at]
                if b.weight is not None:
                    ci = ci * b.weight
                viol = 1.0 - yy * m_now[:, t]
                act = viol > 0
                viol[~act] = 0.0
                r = ci * viol
                fs[t] = r @ viol
                gs[t] = -2.0 * ((r * yy) @ x)
                old = yy * m_before[:, t] < 1.0
                for rows, sign in ((act & ~old, 2.0), (old & ~act, -2.0)):
                    rows = np.flatnonzero(rows)
                    if len(rows):
                        xr = x[rows] * np.sqrt(ci[rows])[:, None]
                        hs[t] += sign * (xr.T @ xr)
            return np.concatenate([fs, gs.ravel(), _upper(hs).ravel()])
        size = n * (1 + d + d * (d + 1) // 2)
        tot = _block_sum(self.blocks, fn, size)
        if tot is None:
            tot = np.zeros(size)
        hess = _square(tot[n + n * d:].reshape(n, -1), d)
        hess += H[ix]
        return tot[:n], tot[n:n + n * d].reshape(n, d), hess

    def values(self, points: np.ndarray, todo: np.ndarray) -> np.ndarray:
        """(problem, point) objectives of the data term at several points of each problem."""
        classes, costs = self.classes, self.costs

        def fn(b: _Block):
            x = b.x()
            at = np.searchsorted(classes, b.label)
            out = np.zeros(points.shape[:2])
            for t, (q, j) in enumerate(todo):
                yy = np.where(b.label == classes[j], 1.0, -1.0)
                ci = costs[q, j][at]
                if b.weight is not None:
                    ci = ci * b.weight
                out[t] = ci @ np.maximum(0.0, 1.0 - yy[:, None] * (x @ points[t].T)) ** 2
            return out
        tot = _block_sum(self.blocks, fn, points.shape[0] * points.shape[1])
        return np.zeros(points.shape[:2]) if tot is None else tot.reshape(points.shape[:2])


def fit_sqhinge_grid(df: DataFrame, n_features: int, classes: Sequence[int], costs: Sequence[np.ndarray], tol: float = 1e-3,
                     max_iter: int = 1000, feat: str = "features", label: str = "label", weight: str | None = None) -> list["LinearSVMModel"]:
    """One model per cost matrix (``class_costs``, ``row_costs``), all fitted in the same passes.

    Generalized Newton: a pass returns f, g and H at the proposed full step for every problem that has not
    converged, so an iteration of the whole grid is one Spark job when the full steps are accepted (the usual
    case).  Problems leave the passes as they converge."""
    classes = np.asarray(list(classes))
    costs = np.stack([np.asarray(c, float) for c in costs])
    n_cand, k, d = len(costs), len(classes), n_features + 1
    W = np.zeros((n_cand, k, d))
    hist: list[list[float]] = [[] for _ in range(n_cand)]
    passes = _Passes(df, classes, costs, d, feat, label, weight)
    f, g, H = passes.at_zero()
    H += np.eye(d)
    g0 = np.maximum(np.linalg.norm(g, axis=2), 1e-12)
    stalled = np.zeros((n_cand, k), bool)     # no step along the Newton direction lowers the objective
    for _ in range(max_iter):
        for q in range(n_cand):
            hist[q].append(float(f[q].sum()))
        active = (np.linalg.norm(g, axis=2) > tol * g0) & ~stalled
        if not active.any():
            break
        todo = np.argwhere(active)
        D = np.zeros_like(W)
        for q, j in todo:
            D[q, j] = -np.linalg.solve(H[q, j], g[q, j])

        def take(point, which):
            """Moves problems to ``point`` with what a pass found there."""
            f1, g1, h1 = found
            for t, (q, j) in which:
                w = point[q, j]
                f[q, j], g[q, j], H[q, j] = f1[t] + 0.5 * w @ w, g1[t] + w, h1[t]
                W[q, j] = w
        full = W + D
        found = passes.at(full, W, H, todo)
        slope = [g[q, j] @ D[q, j] for q, j in todo]
        good = [found[0][t] + 0.5 * full[q, j] @ full[q, j] <= f[q, j] + 0.01 * slope[t] for t, (q, j) in enumerate(todo)]
        refused = [t for t in range(len(todo)) if not good[t]]
        take(full, [(t, todo[t]) for t in range(len(todo)) if good[t]])
        if refused:
            short, back = STEPS[1:], todo[refused]
            points = np.stack([[W[q, j] + s_ * D[q, j] for s_ in short] for q, j in back])
            value = passes.values(points, back) + 0.5 * np.sum(points ** 2, axis=2)
            moved, at = [], W.copy()
            for i, (t, (q, j)) in enumerate(zip(refused, back)):
                ok = [si for si, s_ in enumerate(short) if value[i, si] <= f[q, j] + 0.01 * s_ * slope[t]]
                if ok:
                    at[q, j] = points[i, ok[0]]
                    moved.append((q, j))
                else:
                    stalled[q, j] = True
            if moved:
                moved = np.array(moved)
                found = passes.at(at, W, H, moved)
                take(at, list(enumerate(moved)))
    passes.release()
    done = (np.linalg.norm(g, axis=2) <= tol * g0).all(axis=1)
    return [_reported(LinearSVMModel(W[q], classes.tolist(), hist[q], bool(done[q])), max_iter) for q in range(n_cand)]


def fit_sqhinge_l2(df: DataFrame, n_features: int, classes: Sequence[int], C: float = 1.0,
                   class_weight: Sequence[float] | None = None, tol: float = 1e-3,
                   max_iter: int = 1000, feat: str = "features", label: str = "label",
                   weight: str | None = None) -> LinearSVMModel:
    """One candidate of ``fit_sqhinge_grid``."""
    return fit_sqhinge_grid(df, n_features, classes, [class_costs(classes, C, class_weight)], tol, max_iter, feat, label, weight)[0]


def confusions(df: DataFrame, models: Sequence[LinearSVMModel], feat: str = "features", label: str = "label") -> np.ndarray:
    """(model, true class, predicted class) counts of all models in one pass."""
    classes = np.asarray(models[0].classes)
    W = np.stack([m.W for m in models])
    k = len(classes)

    def fn(b: _Block):
        x = b.x()
        at = np.searchsorted(classes, b.label)
        return np.stack([np.bincount(at * k + np.argmax(x @ w.T, axis=1), minlength=k * k) for w in W]).astype(float)
    tot = _block_sum(packed(df, feat, label, None), fn, len(models) * k * k)
    return np.zeros((len(models), k, k)) if tot is None else tot.reshape(len(models), k, k)


def f1_of_confusion(counts: np.ndarray) -> float:
    """Weighted F1 of a (true, predicted) count matrix; 0 for a class never hit."""
    support, predicted, hit = counts.sum(axis=1), counts.sum(axis=0), np.diag(counts)
    f1 = np.where(hit > 0, 2 * hit / np.maximum(support + predicted, 1), 0.0)
    return float((support * f1).sum() / support.sum()) if support.sum() else 0.0


def _reported(model: LinearSVMModel, max_iter: int) -> LinearSVMModel:
    if not model.converged:
        warnings.warn(f"SVM fit stopped before its tolerance (at most {max_iter} iterations)", RuntimeWarning, stacklevel=3)
    return model


def _l1_newton_direction(w: np.ndarray, g: np.ndarray, H: np.ndarray, rounds: int = 1000, tol: float = 1e-10) -> np.ndarray:
    """Minimiser of  g.d + 0.5 d'Hd + |w + d|_1  (driver, d x d).

    Sweeps of coordinate descent find the signs; between them the non-zero coordinates go straight to the
    minimum of their orthant, stopping where one reaches zero.  Coordinate descent alone creeps where columns depend on
    each other, such as the bias and the categories of a column."""
    u = w.copy()
    Hd = np.zeros_like(w)
    diag = np.maximum(np.diag(H), 1e-12)

    def value(v, hd):
        return g @ (v - w) + 0.5 * (v - w) @ hd + np.abs(v).sum()
    for _ in range(rounds):
        biggest = 0.0
        for t in range(len(w)):
            z = u[t] - (g[t] + Hd[t]) / diag[t]
            step = np.sign(z) * max(abs(z) - 1.0 / diag[t], 0.0) - u[t]
            if step != 0.0:
                Hd += H[:, t] * step
                u[t] += step
                biggest = max(biggest, abs(step))
        moved = 0.0
        for _ in range(2 * len(w)):
            at = np.flatnonzero(u)
            if len(at) == 0:
                break
            sign = np.sign(u[at])
            lam, vec = np.linalg.eigh(H[np.ix_(at, at)])
            step = -vec @ ((vec.T @ (g[at] + Hd[at] + sign)) / np.maximum(lam, 1e-12 * max(lam[-1], 1e-300)))
            cross = step * sign < 0
            reach = np.where(cross, -u[at] / np.where(cross, step, 1.0), np.inf)
            first = int(np.argmin(reach))
            share = min(1.0, float(reach[first]))
            new = u.copy()
            new[at] += share * step
            if share < 1.0:
                new[at[first]] = 0.0
            new_hd = H @ (new - w)
            if not value(new, new_hd) <= value(u, Hd):
                break
            moved = max(moved, float(np.abs(new - u).max()))
            u, Hd = new, new_hd
            if share == 1.0:
                break
        if max(biggest, moved) <= tol:
            break
    return u - w


def fit_sqhinge_l1(df: DataFrame, n_features: int, classes: Sequence[int], C: float = 1.0,
                   class_weight: Sequence[float] | None = None, max_iter: int = 1000,
                   tol: float = 1e-4, feat: str = "features", label: str = "label") -> LinearSVMModel:
    """L1-penalised squared hinge: objective |w|_1 + sum C_i hinge^2.

    Proximal Newton: every iteration is ONE Spark job returning the data-term
    value, gradient and generalized Hessian at the proposed point (shorter steps
    only if that is refused); the L1 sub-problem is solved on the driver (d x d)."""
    classes = np.asarray(list(classes))
    k, d = len(classes), n_features + 1
    W = np.zeros((k, d))
    hist: list[float] = []
    passes = _Passes(df, classes, class_costs(classes, C, class_weight)[None], d, feat, label, None)
    f, g, H = (a[0] for a in passes.at_zero())
    F_cur = f + np.abs(W).sum(axis=1)
    stalled, converged = np.zeros(k, bool), False
    for _ in range(max_iter):
        hist.append(float(F_cur.sum()))
        D = np.stack([_l1_newton_direction(W[j], g[j], H[j]) for j in range(k)])
        if np.max(np.abs(D)) <= tol * max(1.0, np.max(np.abs(W))):
            converged = True
            break
        if stalled.all():
            break
        todo = np.array([(0, j) for j in range(k) if not stalled[j]])
        f1, g1, h1 = passes.at((W + D)[None], W[None], H[None], todo)
        delta = [g[j] @ D[j] + np.abs(W[j] + D[j]).sum() - np.abs(W[j]).sum() for j in range(k)]
        refused, at = [], W.copy()
        for t, (_, j) in enumerate(todo):
            w = W[j] + D[j]
            if f1[t] + np.abs(w).sum() <= F_cur[j] + 0.01 * delta[j]:
                W[j], f[j], g[j], H[j] = w, f1[t], g1[t], h1[t]
            else:
                refused.append((0, j))
        if refused:
            short = STEPS[1:]
            points = np.stack([[W[j] + s_ * D[j] for s_ in short] for _, j in refused])
            value = passes.values(points, np.array(refused)) + np.abs(points).sum(axis=2)
            moved = []
            for i, (_, j) in enumerate(refused):
                ok = [si for si, s_ in enumerate(short) if value[i, si] <= F_cur[j] + 0.01 * s_ * delta[j]]
                if ok:
                    at[j] = points[i, ok[0]]
                    moved.append((0, j))
                else:
                    stalled[j] = True
            if moved:
                f1, g1, h1 = passes.at(at[None], W[None], H[None], np.array(moved))
                for t, (_, j) in enumerate(moved):
                    W[j], f[j], g[j], H[j] = at[j], f1[t], g1[t], h1[t]
        F_cur = f + np.abs(W).sum(axis=1)
    passes.release()
    return _reported(LinearSVMModel(W, classes.tolist(), hist, converged), max_iter)


def balanced_class_weights(df: DataFrame, label: str, classes: Sequence[int],
                           alpha: dict[int, float] | None = None) -> list[float]:
    """n / (k * n_c) per class (one aggregation), optionally times alpha[c]."""
    cnt = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(cnt.values())
    k = len([c for c in classes if cnt.get(c, 0) > 0])
    out = [n / (k * cnt[c]) if cnt.get(c, 0) else 0.0 for c in classes]
    if alpha:
        out = [w * alpha.get(c, 1.0) for c, w in zip(classes, out)]
    return out
