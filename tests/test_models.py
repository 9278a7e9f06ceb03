"""Model fits: objective decreases, gradient equals brute force, skill on a
derived learnable label."""
import numpy as np
from pyspark.sql import functions as F

from tablecraft.operators import linear


def _data(spark, n=3000, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 4))
    score = np.stack([X[:, 0] + 0.5 * X[:, 1], -X[:, 0] + X[:, 2], 0.3 * X[:, 3] - 0.2])
    y = score.argmax(axis=0)
    rows = [(i, int(y[i]), [float(v) for v in X[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, label int, features array<double>"), X, y


def test_gradient_matches_numpy(spark):
    df, X, y = _data(spark, 500)
    W = np.array([[0.1, -0.2, 0.3, 0.0, 0.05], [0.0, 0.1, -0.1, 0.2, -0.05], [0.2, 0.0, 0.0, -0.3, 0.1]])
    f, g = linear.loss_grad_at(df, W, [0, 1, 2], 2.0, [1.0, 1.5, 0.5])
    Xb = np.hstack([X, np.ones((len(X), 1))])
    for j, cw in enumerate([1.0, 1.5, 0.5]):
        yy = np.where(y == j, 1.0, -1.0)
        ci = np.where(yy > 0, 2.0 * cw, 2.0)
        m = Xb @ W[j]
        v = np.maximum(0, 1 - yy * m)
        assert abs(f[j] - (0.5 * W[j] @ W[j] + np.sum(ci * v ** 2))) < 1e-8
        act = v > 0
        gw = W[j] + 2 * Xb[act].T @ (ci[act] * (m[act] - yy[act]))
        assert np.allclose(g[j], gw, atol=1e-8)


def test_svm_objective_decreases_and_learns(spark):
    from tablecraft.operators.metrics import f1_weighted
    df, X, y = _data(spark, 3000)
    df = df.persist()
    cw = linear.balanced_class_weights(df, "label", [0, 1, 2])
    m = linear.fit_sqhinge_l2(df, 4, [0, 1, 2], 1.0, cw)
    assert all(b <= a + 1e-9 for a, b in zip(m.history, m.history[1:]))
    f1 = f1_weighted(m.transform(df))
    majority = np.bincount(y).max() / len(y)
    assert f1 > 0.8 and f1 > majority
    l1 = linear.fit_sqhinge_l1(df, 4, [0, 1, 2], 1.0, cw, max_iter=50)
    assert all(b <= a + 1e-6 for a, b in zip(l1.history, l1.history[1:]))
    assert f1_weighted(l1.transform(df)) > 0.8


def test_scoring_invariant_under_repartition(spark):
    df, _, _ = _data(spark, 400)
    W = np.arange(15, dtype=float).reshape(3, 5) / 10
    m = linear.LinearSVMModel(W, [0, 1, 2])
    a = m.transform(df).select("row_id", "prediction")
    b = m.transform(df.repartition(7)).select("row_id", "prediction")
    assert a.exceptAll(b).count() == 0


def _newton(X, y, cost, tol=1e-9):
    """Direct minimiser of one squared-hinge problem; ``cost`` by row."""
    Xb = np.hstack([X, np.ones((len(X), 1))])
    w = np.zeros(Xb.shape[1])

    def obj(v):
        return 0.5 * v @ v + np.sum(cost * np.maximum(0, 1 - y * (Xb @ v)) ** 2)
    for _ in range(200):
        m = Xb @ w
        a = y * m < 1
        g = w + 2 * Xb[a].T @ (cost[a] * (m[a] - y[a]))
        if np.linalg.norm(g) < tol:
            break
        d = -np.linalg.solve(np.eye(len(w)) + 2 * (Xb[a] * cost[a][:, None]).T @ Xb[a], g)
        s = 1.0
        while obj(w + s * d) > obj(w) + 1e-4 * s * (g @ d) and s > 1e-10:
            s /= 2
        w = w + s * d
    return w


def test_grid_fit_reaches_every_optimum(spark):
    """All candidates of one chain of passes equal direct solutions; labels may weigh by class or by row."""
    df, X, y = _data(spark, 600, 3)
    df = df.repartition(3).persist()
    cw, rw = [1.0, 1.7, 0.6], [0.5, 1.0, 2.5]
    costs = [linear.class_costs([0, 1, 2], c, cw) for c in (0.1, 1.0, 10.0)] + [linear.row_costs([0, 1, 2], 0.7, rw)]
    models = linear.fit_sqhinge_grid(df, 4, [0, 1, 2], costs, tol=1e-8)
    assert all(m.converged for m in models)
    for cost, m in zip(costs, models):
        for j in range(3):
            want = _newton(X, np.where(y == j, 1.0, -1.0), cost[j][y])
            assert np.allclose(m.W[j], want, atol=1e-5)
    tables = linear.confusions(df, models)
    from tablecraft.operators.metrics import f1_weighted
    for m, t in zip(models, tables):
        assert t.sum() == 600 and abs(linear.f1_of_confusion(t) - f1_weighted(m.transform(df))) < 1e-12


def test_unfinished_fits_say_so(spark):
    import pytest
    df, _, _ = _data(spark, 300, 4)
    with pytest.warns(RuntimeWarning):
        m = linear.fit_sqhinge_grid(df, 4, [0, 1, 2], [linear.class_costs([0, 1, 2], 5.0)], tol=1e-12, max_iter=1)
    assert not m[0].converged


def test_selection_keeps_every_trial(spark):
    """Candidates of one preprocessing share frames and passes; scores equal separate fits, in order."""
    from pyspark.sql import functions as F
    from tablecraft.plans import pipelines as P
    df, X, y = _data(spark, 600, 5)
    flat = df.select("row_id", "label", *[F.col("features")[j].alias(f"x{j}") for j in range(4)], F.when(F.col("row_id") % 3 == 0, "a").otherwise("b").alias("cat"))
    tr, va = flat.filter("row_id % 4 > 0").persist(), flat.filter("row_id % 4 = 0").persist()
    wide, rare = P.Prep(), P.Prep(min_frequency=10)
    cands = [P.Candidate(wide, P.Clf(C=1.0)), P.Candidate(rare, P.Clf(C=0.1)), P.Candidate(wide, P.Clf(C=0.01)), P.Candidate(wide, P.Clf(penalty="l1")),
             P.Candidate(rare, P.Clf(balanced=False, sample_alpha=2.0))]
    together = P.evaluate(cands, tr, va)
    assert [t.candidate for t in together] == cands and all(t.converged for t in together)
    alone = [P.evaluate([c], tr, va)[0].f1 for c in cands]
    assert np.allclose([t.f1 for t in together], alone)
    # row weights as a column give the same model as the cost matrix
    fp = P.fit_prep(tr, rare)
    m = P.fit_classifier(fp.features(tr), fp.n_features, cands[4].clf)
    from tablecraft.operators.metrics import f1_weighted
    assert abs(f1_weighted(m.transform(fp.features(va))) - together[4].f1) < 1e-9


def test_l1_direction_is_the_minimum_on_dependent_columns():
    """A column far from zero, the categories of a column and the bias depend on each other: coordinate descent creeps there."""
    rng = np.random.default_rng(6)
    n = 2000
    X = np.column_stack([1000 + rng.normal(size=n), rng.normal(size=n), np.eye(5)[rng.integers(0, 5, n)], np.ones(n)])
    y = np.where(X[:, 1] + rng.normal(size=n) > 0, 1.0, -1.0)
    H, g, w = 2 * X.T @ X, -2 * X.T @ y, np.zeros(X.shape[1])
    u = w + linear._l1_newton_direction(w, g, H, 200)
    r = g + H @ (u - w)
    off = np.where(u != 0, np.abs(r + np.sign(u)), np.maximum(0, np.abs(r) - 1))
    assert off.max() < 1e-3


def test_blocks_hold_zeros_and_ones_as_bits(spark):
    from pyspark.sql import functions as F
    df, X, y = _data(spark, 50)
    wide = df.select("label", F.concat("features", *[F.array((F.col("row_id") % k == 0).cast("double")) for k in range(1, 21)]).alias("features"), F.lit(2.0).alias("w"))
    blocks = linear.packed(wide, "features", "label", "w").collect()
    assert sum(b.n for b in blocks) == 50 and all(b.bits.shape[1] == 3 and b.rest.shape[1] == 4 for b in blocks)
    x = np.vstack([b.x() for b in blocks])
    assert np.array_equal(x[:, :4], X) and np.array_equal(x[:, 4:24].sum(axis=0), [len(range(0, 50, k)) for k in range(1, 21)]) and (x[:, 24] == 1).all()


def test_hessian_of_moved_rows_equals_the_direct_one(spark):
    """Only rows that enter or leave the margin change the Hessian; with row weights too."""
    df, X, y = _data(spark, 400, 8)
    df = df.withColumn("w", (df.row_id % 3 + 1).cast("double")).repartition(3)
    sw, Xb = np.arange(400) % 3 + 1.0, np.hstack([X, np.ones((400, 1))])
    costs = np.stack([linear.class_costs([0, 1, 2], c, [1.0, 2.0, 0.5]) for c in (0.5, 2.0)])
    p = linear._Passes(df, np.arange(3), costs, 5, "features", "label", "w")
    zero, todo = np.zeros((2, 3, 5)), np.array([(0, 0), (1, 2)])
    W = np.random.default_rng(9).normal(size=zero.shape)
    f, g, H = p.at(W, zero, p.at_zero()[2], todo)
    for t, (q, j) in enumerate(todo):
        yy = np.where(y == j, 1.0, -1.0)
        ci, v = costs[q, j][y] * sw, np.maximum(0, 1 - yy * (Xb @ W[q, j]))
        a = v > 0
        assert np.isclose(f[t], ci @ v ** 2) and np.allclose(g[t], -2 * (ci * v * yy) @ Xb)
        assert np.allclose(H[t], 2 * (Xb[a] * ci[a][:, None]).T @ Xb[a])
    assert np.allclose(p.values(W[tuple(todo.T)][:, None, :], todo)[:, 0], f)
    p.release()


def test_random_features_of_batches(spark):
    """Batches of any size, without rows and without inputs, give one array per row."""
    from tablecraft.operators.rff import RandomFourierFeatures
    df, X, _ = _data(spark, 60, 7)
    r = RandomFourierFeatures(4, 8, 0.5)
    got = {v.row_id: v.z for v in r.transform(df.repartition(3), "features", "z").collect()}
    assert np.allclose([got[i] for i in range(60)], r.scale * np.cos(X @ r.W + r.b))
    assert r.transform(df.filter("row_id < 0"), "features", "z").count() == 0
    none = RandomFourierFeatures(0, 3, 0.5)
    flat = none.transform(df.selectExpr("array() as v").selectExpr("cast(v as array<double>) as v"), "v", "z").collect()
    assert len(flat) == 60 and np.allclose(flat[0].z, none.scale * np.cos(none.b))


def _bookings(spark, n=300):
    rng = np.random.default_rng(11)
    rows = [(i, int(rng.integers(0, 3)), float(np.exp(rng.normal() * 2)), None if i % 7 == 0 else float(rng.integers(0, 9)), float(rng.normal()), None,
             "abc"[int(rng.integers(0, 3))] if i % 5 else None) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, label int, a double, b double, c double, d double, e string")


def test_preparations_fitted_together_measure_once(spark, monkeypatch):
    """Preparations of one grid take one profile and one search for quantiles, and equal the stages fitted one after the other."""
    from tablecraft.operators import stats
    from tablecraft.operators.transforms import ImputeMedian, Scaler, SkewClipLog
    from tablecraft.plans import pipelines as P
    df = _bookings(spark).persist()
    calls = {"column_profile": 0, "category_counts": 0, "quantile_neighbours": 0}
    for name in calls:
        def counted(*args, _of=getattr(stats, name), _name=name, **kw):
            calls[_name] += 1
            return _of(*args, **kw)
        monkeypatch.setattr(stats, name, counted)
    preps = [P.Prep(skew=(lo, 100 - lo, t), min_frequency=m) for lo in (1.0, 5.0) for t in (0.5, 50.0) for m in (None, 10)] + [P.Prep()]
    fitted = P.fit_preps(df, preps)
    assert calls == {"column_profile": 1, "category_counts": 3, "quantile_neighbours": 1}      # a mode, two vocabularies
    for p, f in zip(preps, fitted):
        x, counts = df, None
        if p.skew:
            state = SkewClipLog(*p.skew, columns=["a", "b", "c", "d"]).fit(df)
            x, counts = state.apply(x), state.counts
            assert f.steps[0].rules == state.rules
        fill = ImputeMedian(["a", "b", "c", "d"], counts=counts).fit(x)
        scale = Scaler(False, ["a", "b", "c"]).fit(fill.apply(x))
        got_fill, got_scale = f.steps[-3:-1]
        assert got_fill.fill == fill.fill and got_fill.dropped == ["d"] and f.num_cols == ["a", "b", "c"]
        assert all(np.allclose(got_scale.params[c], scale.params[c], rtol=1e-12) for c in scale.params)
        assert f.n_features == 6 and all(len(r.features) == 6 for r in f.features(df).take(5))
        f.release()
    df.unpersist()


def test_second_phase_uses_the_same_split(spark, monkeypatch):
    from tablecraft.plans import pipelines as P
    splits = []
    real = P.stratified_split
    monkeypatch.setattr(P, "stratified_split", lambda *a, **k: splits.append(1) or real(*a, **k))
    monkeypatch.setattr(P, "grid", lambda name: [P.Candidate(P.Prep(), P.Clf(C=c)) for c in (0.5, 1.0)])
    best, phases = P.select_model("E14", _bookings(spark))
    assert [n for n, _ in phases] == ["A", "B"] and len(phases[1][1]) == 6 and len(splits) == 1


def _orders(spark, n=600):
    """Booking-like rows with two categories, a number with gaps and a binary column."""
    return spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("label"), F.concat(F.lit("c"), (F.col("id") * 7 % 11).cast("string")).alias("country"),
                                 F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("deposit"), F.when(F.col("id") % 5 > 0, (F.col("id") % 13).cast("double")).alias("adr"))


def test_kept_frames_have_tasks_by_rows_not_by_shuffle_partitions(spark):
    from tablecraft.operators.sampling import in_tasks, stratified_split
    from tablecraft.operators.transforms import OneHot, TargetEncoder
    cores = spark.sparkContext.defaultParallelism
    rows = _orders(spark)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(9 * cores))
    try:
        split = stratified_split(rows, "label", 20, 42, n_rows=600)
        few = in_tasks(split, 600).persist()
        assert sorted(map(tuple, few.collect()), key=str) == sorted(map(tuple, split.collect()), key=str)
        assert few.rdd.getNumPartitions() <= cores
        assert in_tasks(spark.range(0, 100, 1, 7 * cores), 50_000 * 5 * cores).rdd.getNumPartitions() == 5 * cores
        te, oh = TargetEncoder(["country"], "label").fit(rows), OneHot(columns=["deposit"], drop_first=True).fit(rows)
        assert te.table.rdd.getNumPartitions() <= cores and oh.codes.rdd.getNumPartitions() <= cores
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_notebook_features_keep_the_encoded_training_rows(spark):
    """No statistic joins the encodings again; kept and encoded anew, the features are equal."""
    from tablecraft.plans.catalog_models import NBFeatures
    rows = _orders(spark).persist()
    fe = NBFeatures(rows, ["country"], ["deposit"])
    assert fe.encoded.storageLevel.useMemory
    kept, anew = fe.apply(rows), fe.apply(rows.select("*"))
    assert sorted(kept.collect()) == sorted(anew.collect()) and kept.count() == 600


def test_hinge_fits_read_a_short_plan(spark, monkeypatch):
    from pyspark.ml.classification import LinearSVC
    from tablecraft.plans import pipelines as P
    seen, fit = [], LinearSVC.fit

    def spied(self, df, params=None):
        seen.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        return fit(self, df)
    monkeypatch.setattr(LinearSVC, "fit", spied)
    rows = _orders(spark).persist()
    wide = rows.select("row_id", "label", F.array(*[F.coalesce((F.col("country") == f"c{i % 11}").cast("double") * (i + 1), F.lit(0.0)) for i in range(60)]).alias("features"))
    model = P.fit_classifier(wide, 60, P.Clf(loss="hinge"))
    assert len(seen) == 3 and max(seen) < 1000
    assert model.transform(wide).select("prediction").where("prediction is null").count() == 0


def test_driver_gets_large_sums_once(spark, monkeypatch):
    """Partial sums of many or large arrays are added up by tasks, in the order of their partitions."""
    from pyspark import RDD
    blocks, got, collect = spark.sparkContext.parallelize(range(12), 12), [], RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: got.append(collect(self)) or got[-1])
    size = 400_000
    total = linear._block_sum(blocks, lambda b: np.full(size, 0.1 * b), size)
    want = 0.0
    for b in range(12):
        want = want + 0.1 * b
    assert (total == want).all() and total.shape == (size,)
    received = sum(v[1].nbytes if isinstance(v, tuple) else v.nbytes for rows in got for v in rows)
    assert received == 8 * size
    many = spark.sparkContext.parallelize(range(80), 80)
    assert linear._block_sum(many, lambda b: np.array([1.0, b]), 2).tolist() == [80.0, 3160.0]
    assert linear._block_sum(spark.sparkContext.parallelize([], 80), lambda b: np.ones(2), 2) is None


def test_blocks_of_wide_rows_are_small(spark):
    from pyspark.sql import functions as F
    wide = spark.range(3000, numPartitions=2).select((F.col("id") % 3).alias("label"), F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda k: F.col("id") / k).alias("features"))
    blocks = linear.packed(wide, "features", "label", None).collect()
    assert sum(b.n for b in blocks) == 3000 and max(b.rest.nbytes for b in blocks) <= 8 << 20
    x = np.vstack([b.x() for b in blocks])
    assert x.shape == (3000, 1001) and np.array_equal(np.sort(x[:, 0]), np.arange(3000.0)) and np.allclose(x[:, 9] * 10, x[:, 0])


def test_forests_read_their_rows_in_few_tasks(spark, monkeypatch):
    from tablecraft.operators import trees
    rows = spark.range(400).repartition(40)
    assert trees.few_tasks(rows, 400).rdd.getNumPartitions() == 40
    monkeypatch.setattr(trees, "TASK_ROWS", 50)
    few = trees.few_tasks(rows, 400)
    assert few.rdd.getNumPartitions() == 8 and few.count() == 400
