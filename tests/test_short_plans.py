"""Fits that plan per value, not per column: same results, few expressions."""
import numpy as np
from pyspark.sql import functions as F


def test_only_columns_of_many_values_are_sketched(spark, monkeypatch):
    from tablecraft.operators import stats
    df = spark.range(2000).select(*[(F.col("id") % (k + 3)).cast("double").alias(f"few{k}") for k in range(3)],
                                  ((F.col("id") * 7919) % 2000).cast("double").alias("many"),
                                  F.when(F.col("id") % 3 == 0, F.col("id") % 5).alias("some"), F.lit(None).cast("double").alias("none"))
    sketched, count = [], stats._count_brackets
    monkeypatch.setattr(stats, "_count_brackets", lambda d, xs, ts: (sketched.extend(t["col"] for t in ts), count(d, xs, ts))[1])
    got = stats.exact_quantiles(df, df.columns, [0.02, 0.5, 0.98], max_bracket_values=100)
    assert set(sketched) == {"many"}
    rows = df.toPandas()
    for c in df.columns[:-1]:
        assert np.allclose(got[c], np.quantile(rows[c].dropna().astype(float), [0.02, 0.5, 0.98])), c
    assert got["none"] == [None] * 3


def test_targets_of_one_bracket_share_a_histogram(spark):
    from tablecraft.operators import stats
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    ts = [{"col": "x", "lo": 10.0, "hi": 12.0} for _ in range(2)] + [{"col": "x", "lo": None, "hi": 1.0}]
    got = stats._bracket_histograms(df, {"x": F.col("x")}, ts)
    assert [got[id(t)] for t in ts] == [[(10.0, 1), (11.0, 1), (12.0, 1)]] * 2 + [[(0.0, 1), (1.0, 1)]]
    assert got[id(ts[0])] is got[id(ts[1])]


def test_binner_has_one_sketch_for_all_features(spark, monkeypatch):
    from tablecraft.operators import boosting
    made, sketch = [], F.percentile_approx
    monkeypatch.setattr(boosting.F, "percentile_approx", lambda *a: (made.append(1), sketch(*a))[1])
    rows = [(i % 2, [float(i % 7), None if i % 3 else float(i), float("nan"), float(i % 4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "model int, features array<double>")
    zero, one = boosting.fit_binner(df, 4, "model", 16, {3: 4})
    assert len(made) == 1
    for m, b in enumerate((zero, one)):
        mine = [x for k, x in rows if k == m]
        assert b.edges[0].tolist() == sorted({x[0] for x in mine}) and b.edges[1].tolist() == sorted(x[1] for x in mine if x[1] is not None)
        assert len(b.edges[2]) == 0 and b.edges[3] is None and b.width.tolist() == [9, len(b.edges[1]) + 2, 2, 5]
    assert [b.edges for b in boosting.fit_binner(df, 4, None, 16, {j: 9 for j in range(4)})] == [[None] * 4]


def test_encodings_come_in_one_projection(spark):
    from tablecraft.operators.transforms import TargetEncoder
    df = spark.createDataFrame([(i, "ab"[i % 2], i % 3, [None, "u", "v"][i % 3], 1.0 * i) for i in range(30)], "row_id long, a string, label int, b string, x double")
    state = TargetEncoder(["a", "b"]).fit(df)
    out = state.apply(df)
    assert out.columns == ["row_id", "label", "x", *[f"{c}_{j}" for c in "ab" for j in range(3)]]
    lines = [x.strip(" :+-").split()[0] for x in out._jdf.queryExecution().analyzed().toString().splitlines()]
    assert lines[:3] == ["Project", "Join", "Join"]
    want = {v: [(sum(1 for i in range(30) if [None, "u", "v"][i % 3] == v and i % 3 == j) + 5 / 3) / 15 for j in range(3)] for v in "uv"}
    for r in out.join(df.select("row_id", "b"), "row_id").collect():
        assert np.allclose([r.b_0, r.b_1, r.b_2], want.get(r.b, [1 / 3] * 3))
    assert state.apply(df, keep=True).columns == [*df.columns, *out.columns[3:]]
