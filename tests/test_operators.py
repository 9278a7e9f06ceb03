"""Distributed primitives against brute force, plus invariants."""
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablecraft.operators import ensemble, sampling, stats
from tablecraft.operators.transforms import OneHot, SkewClipLog, TargetEncoder


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.lognormal(size=5000), 3)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    # force the narrowing path with a tiny bracket budget
    got = stats.exact_quantiles(df, ["x"], probs, accuracy=100, max_bracket_values=50)["x"]
    want = np.quantile(x, probs)  # linear interpolation
    assert np.allclose(got, want, rtol=0, atol=1e-12)


def test_quantiles_all_null_and_constant(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 1.0)], "a double, b double")
    q = stats.exact_quantiles(df, ["a", "b"], [0.1, 0.9])
    assert q["a"] == [None, None] and q["b"] == [1.0, 1.0]


def test_skew_clip_log_edges(spark):
    rows = [(1.0, None, float(-i) if i == 0 else float(i ** 3), 5.0) for i in range(50)]
    df = spark.createDataFrame(rows, "const double, allnull double, negskew double, x double")
    st = SkewClipLog(columns=["const", "allnull", "negskew"]).fit(df)
    assert "const" not in st.bounds and "allnull" not in st.bounds   # lo == hi / no values
    assert "negskew" in st.bounds and "negskew" in st.log_cols        # min 0, high skew
    two = spark.createDataFrame([(1.0,), (2.0,)], "y double")
    st2 = SkewClipLog(columns=["y"]).fit(two)
    assert st2.log_cols == []  # skewness undefined for n < 3


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,), (None,), (None,)], "c string")
    assert stats.modes(df, ["c"]) == {"c": "a"}


def test_exact_rank_matches_window(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("label"))
    k = df.withColumn("_h", sampling.hash_key("row_id", 5))
    want = k.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("_h")))
    for n_rows in (None, 10_000_000, 10 ** 12):  # 2, 2 and 4 hex digits
        got = sampling.exact_rank(k, ["label"], "_h", "r", n_rows=n_rows)
        diff = got.select("row_id", "r").exceptAll(want.select("row_id", "r")).count()
        assert diff == 0


def test_folds_disjoint_exhaustive_balanced(spark):
    df = spark.range(1003).select(F.col("id").alias("row_id"),
                                  F.when(F.col("id") % 10 == 0, 2).otherwise(F.col("id") % 2).alias("label"))
    kf = sampling.stratified_kfold(df, "label", 5, 42)
    assert kf.count() == 1003 and kf.select("row_id").distinct().count() == 1003
    per = kf.groupBy("label", "fold").agg(F.count("*").alias("n")).groupBy("label") \
        .agg((F.max("n") - F.min("n")).alias("spread"))
    assert all(r.spread <= 1 for r in per.collect())


def test_oversample_counts(spark):
    rows = [(i, 0) for i in range(100)] + [(100 + i, 2) for i in range(2)]
    df = spark.createDataFrame(rows, "row_id long, label int")
    for r, want in ((0.05, 5), (0.10, 10), (0.20, 20), (0.01, 2)):
        out = sampling.oversample(df, "label", r, 42)
        assert out.where("label = 2").count() == want
        assert out.where("label = 0").count() == 100
    # round half to even: 0.025 * 100 = 2.5 -> 2 (no-op on n2 = 2)
    assert sampling.oversample_plan(df, "label", 0.025).target == 2


def test_target_encoding_sums_to_one_and_unseen_prior(spark):
    train = spark.createDataFrame([(i, c, y) for i, (c, y) in enumerate(
        [("a", 0), ("a", 1), ("b", 2), ("b", 2), ("c", 0), (None, 1)])], "row_id long, c string, label int")
    st = TargetEncoder(["c"], "label").fit(train)
    test = spark.createDataFrame([(10, "a"), (11, "zzz"), (12, None)], "row_id long, c string")
    out = st.apply(test).orderBy("row_id").collect()
    for r in out:
        assert abs(r.c_0 + r.c_1 + r.c_2 - 1.0) < 1e-12
    prior = [st.prior[j] for j in (0, 1, 2)]
    assert [out[1].c_0, out[1].c_1, out[1].c_2] == prior == [out[2].c_0, out[2].c_1, out[2].c_2]
    # category 'a': n=2, n_0=1 -> (1 + 5 * 2/6) / 7
    assert abs(out[0].c_0 - (1 + 5 * 2 / 6) / 7) < 1e-12


def test_onehot_minfreq_drop_binary_unseen(spark):
    train = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] * 1, "c string")
    st = OneHot(min_frequency=3, columns=["c"]).fit(train)
    assert st.categories["c"] == ["a", "b", "__infrequent__"]
    st2 = OneHot(min_frequency=4, drop_if_binary=True, columns=["c"]).fit(train)
    assert st2.categories["c"] == ["__infrequent__"]  # [a, infrequent] is binary -> first dropped
    test = spark.createDataFrame([("a",), ("c",), ("zzz",)], "c string")
    out = st.apply(test).collect()
    assert [(r.c_a, r.c_b, r.c___infrequent__) for r in out] == [(1, 0, 0), (0, 0, 1), (0, 0, 0)]


def test_ewa_closed_form_equals_recursion(spark):
    rng = np.random.default_rng(3)
    T, K, eta = 600, 3, 0.5
    loss = rng.exponential(size=(T, K))
    rows = [(t, f"e{k}", float(loss[t, k])) for t in range(T) for k in range(K)]
    df = spark.createDataFrame(rows, "t long, expert string, loss double").withColumn("row_id", F.col("t"))
    traj = ensemble.ewa_trajectory(df, "t", eta, bucket_width=64).where("t = 599").orderBy("expert").collect()
    w = np.ones(K) / K
    for t in range(T):
        w = w * np.exp(-eta * loss[t])
        w = w / w.sum()
    assert np.allclose([r.weight for r in traj], w, atol=1e-12)
    fin = ensemble.ewa_weights(df, eta).orderBy("expert").collect()
    assert np.allclose([r.weight for r in fin], w, atol=1e-12)


def test_fold_summary_population_std(spark):
    from tablecraft.operators.metrics import summary
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.1, 0.2, 0.3, 0.4, 0.5])], "fold int, v double")
    r = summary(df, "v").first()
    assert abs(r["mean"] - 0.3) < 1e-12 and abs(r["std"] - np.std([0.1, 0.2, 0.3, 0.4, 0.5])) < 1e-12


def test_weighted_f1_never_predicted_class(spark):
    from tablecraft.operators.metrics import f1_weighted
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (2, 2)], "label int, prediction int")
    # class 1 never predicted -> f1 0; class 0: tp 2, support 2, predicted 3 -> 0.8; class 2: 1
    assert abs(f1_weighted(df) - (2 * 0.8 + 1 * 0 + 1 * 1.0) / 4) < 1e-12


def test_splits_independent_of_partitioning(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("label"))
    a = sampling.stratified_split(df, "label", 20, 42).select("row_id", "is_val")
    b = sampling.stratified_split(df.repartition(11), "label", 20, 42).select("row_id", "is_val")
    assert a.exceptAll(b).count() == 0
    c = sampling.stratified_kfold(df.repartition(5, "label"), "label", 5, 42).select("row_id", "fold")
    d = sampling.stratified_kfold(df, "label", 5, 42).select("row_id", "fold")
    assert c.exceptAll(d).count() == 0
    r1 = sampling.random_split(df, 0.8, 13).select("row_id", "is_train")
    r2 = sampling.random_split(df.repartition(3), 0.8, 13).select("row_id", "is_train")
    assert r1.exceptAll(r2).count() == 0
