"""Sparse rows and the Hessian-free SVM against dense and direct solutions."""
import numpy as np
import pytest

from tablecraft.operators import linear, sparse
from tablecraft.operators.dictionary import category_codes

ROWS = "row_id long, label int, indices array<long>, values array<double>"


def _direct(X, y, tol=1e-10):
    """Minimiser of one squared-hinge problem with unit costs, by plain Newton steps."""
    Xb = np.hstack([X, np.ones((len(X), 1))])
    w = np.zeros(Xb.shape[1])

    def cost(v):
        return 0.5 * v @ v + (np.maximum(0, 1 - y * (Xb @ v)) ** 2).sum()
    while True:
        on = Xb[y * (Xb @ w) < 1]
        g = w + 2 * on.T @ (on @ w - y[y * (Xb @ w) < 1])
        if np.linalg.norm(g) < tol:
            return w
        d, s = -np.linalg.solve(np.eye(len(w)) + 2 * on.T @ on, g), 1.0
        while cost(w + s * d) > cost(w) + 1e-4 * s * (g @ d) and s > 1e-10:
            s /= 2
        w = w + s * d


def _wide(n, width, seed):
    rng = np.random.default_rng(seed)
    slots = np.stack([np.sort(rng.choice(width, 4, replace=False)) for _ in range(n)])
    score = np.random.default_rng(seed + 1).normal(size=(3, width))
    y = np.argmax(score[:, slots].sum(axis=2), axis=0)
    return [(k, int(y[k]), slots[k].tolist(), [1.0, 0.5, 1.0, 2.0]) for k in range(n)], slots, y


def test_same_optimum_as_the_dense_solver(spark):
    data, slots, y = _wide(400, 30, 5)
    dense = np.zeros((400, 30))
    np.put_along_axis(dense, slots, np.array([1.0, 0.5, 1.0, 2.0]), axis=1)
    rows = spark.createDataFrame(data, ROWS).repartition(3).persist()
    full = spark.createDataFrame([(k, int(v), dense[k].tolist()) for k, v in enumerate(y)], "row_id long, label int, features array<double>")
    weight = linear.balanced_class_weights(rows, "label", [0, 1, 2])
    a = sparse.fit_sqhinge_sparse(rows, 30, [0, 1, 2], 2.0, weight, tol=1e-6)
    b = linear.fit_sqhinge_l2(full, 30, [0, 1, 2], 2.0, weight, tol=1e-6)
    assert a.converged and b.converged and np.abs(a.W - b.W).max() < 1e-4
    assert all(q <= p + 1e-9 for p, q in zip(a.history, a.history[1:]))
    got = {r.row_id: r.prediction for r in sparse.score_sparse(rows, a).collect()}
    assert got == {r.row_id: r.prediction for r in b.transform(full).collect()}


def test_fifty_thousand_slots(spark):
    """Slots that no row holds stay at zero; the others equal a direct solution over the slots in use."""
    data, slots, y = _wide(300, 50_000, 9)
    rows = spark.createDataFrame(data, ROWS).persist()
    model = sparse.fit_sqhinge_sparse(rows, 50_000, [0, 1, 2], tol=1e-7)
    assert model.converged and model.W.shape == (3, 50_001)
    used, at = np.unique(slots, return_inverse=True)
    X = np.zeros((300, len(used)))
    np.put_along_axis(X, at.reshape(slots.shape), np.array([1.0, 0.5, 1.0, 2.0]), axis=1)
    for j in range(3):
        w = _direct(X, np.where(y == j, 1.0, -1.0))
        assert np.abs(model.W[j, np.append(used, 50_000)] - w).max() < 1e-4
    assert not np.delete(model.W[:, :-1], used, axis=1).any()


def test_assembly_edges(spark):
    """Null and zero numbers, null and unseen categories have no entry; an empty table has no rows and weights of zero."""
    df = spark.createDataFrame([(1, 2.0, 0, "x"), (2, None, 3, "y"), (3, 1.5, None, None), (4, 0.0, 0, "new")], "row_id long, a double, b int, c string")
    codes, sizes = category_codes(df.where("row_id < 3"), ["c"])
    rows, width = sparse.assemble_sparse(df, ["row_id"], ["a", "b"], codes, sizes)
    got = {r.row_id: dict(zip(r.indices, r.values)) for r in rows.collect()}
    assert width == 4 and sizes == {"c": 2}
    assert got[3] == {0: 1.5} and got[4] == {}
    assert got[1][0] == 2.0 and got[2][1] == 3.0 and {max(got[1]), max(got[2])} == {2, 3}
    none = spark.createDataFrame([], ROWS)
    model = sparse.fit_sqhinge_sparse(none, 4, [0, 1, 2])
    assert model.converged and not model.W.any() and sparse.score_sparse(none, model).count() == 0


def test_unreached_tolerance_is_reported(spark):
    rows = spark.createDataFrame(_wide(100, 20, 2)[0], ROWS)
    with pytest.warns(RuntimeWarning):
        assert not sparse.fit_sqhinge_sparse(rows, 20, [0, 1, 2], tol=1e-9, max_iter=1).converged
