"""Running sums by levels equal the sequential recursion."""
import numpy as np

from tablecraft.operators.ensemble import ewa_trajectory, running_sum


def test_three_levels(spark):
    rng = np.random.default_rng(4)
    t = np.sort(rng.choice(np.arange(-500, 5000), 700, replace=False))
    rows = [(e, int(x), float(v)) for e in ("a", "b") for x, v in zip(t, rng.integers(0, 9, len(t)))]
    df = spark.createDataFrame(rows, "expert string, t long, loss double").repartition(5)
    got = {(r.expert, r.t): r.s for r in running_sum(df, ["expert"], "t", "loss", "s", bucket_width=8, offsets=6).collect()}
    want = {}
    for e in ("a", "b"):
        acc = 0.0
        for _, x, v in filter(lambda r: r[0] == e, rows):
            acc += v
            want[e, x] = acc
    assert got == want                       # whole numbers: sums are exact in any order


def test_trajectory_equals_the_recursion(spark):
    rng = np.random.default_rng(5)
    loss = rng.random((40, 2))
    df = spark.createDataFrame([(k, k, e, float(loss[k, i])) for k in range(40) for i, e in enumerate("ab")], "t long, row_id long, expert string, loss double")
    w, want = np.ones(2), {}
    for k in range(40):
        w = w * np.exp(-0.5 * loss[k])
        want |= {(k, "a"): w[0] / w.sum(), (k, "b"): w[1] / w.sum()}
    got = {(r.t, r.expert): r.weight for r in ewa_trajectory(df, eta=0.5, bucket_width=4).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_empty(spark):
    none = spark.createDataFrame([], "expert string, t long, loss double")
    assert running_sum(none, ["expert"], "t", "loss", "s", 8).count() == 0
