"""Model fits, scoring, stacking and the 14 SVM compositions (rows-only
checks), plus SQL-checkable pieces of the linear model (objective and
gradient at fixed weights, linear scoring)."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import prob_clip
from ..operators import linear, sparse, stats, trees
from ..operators.boosting import Boosting, fit_boosting
from ..operators.dictionary import category_codes, with_codes
from ..operators.encoding import route_columns
from ..operators.metrics import p_true_from_array, per_class_f1_grouped
from ..operators.rff import RandomFourierFeatures
from ..operators.sampling import in_tasks, stratified_kfold, stratified_split
from ..operators.transforms import ImputeMedian, OneHot, Scaler, TargetEncoder
from ..sources.bookings import with_bookings
from ..session import cut_lineage
from . import pipelines as P
from . import stacking as S
from .common import BOOKING_NUMERIC, BOOKING_STRING, LABELED_CTE, SPLIT_CTE, labeled, reuse, r6, with_split
from .registry import register

CLASSES = (0, 1, 2)


def rows_train_test(spark, sf):
    """All labeled rows, kept, and their stratified 80/20 split."""
    rows = reuse(labeled(spark, sf))
    n = rows.count()
    sp = reuse(in_tasks(stratified_split(rows, "label", 20, 42, n_rows=n), n))
    return rows, sp.where(~F.col("is_val")).drop("is_val"), sp.where("is_val").drop("is_val")


def train_test(spark, sf):
    """Stratified 80/20: train rows keep labels, test rows are scored."""
    return rows_train_test(spark, sf)[1:]


# --------------------------------------------------------------------------
# linear model pieces with SQL oracles
# --------------------------------------------------------------------------

# Weights of the fixed-point objective check (3 classes x
# (3 features + bias)).
W_FIXED = np.array([[0.1, -0.2, 0.3, 0.05],
                    [-0.1, 0.2, 0.1, -0.05],
                    [0.05, 0.05, -0.2, 0.1]])
_X_SPARK = [lambda: F.coalesce(F.col("lead_time"), F.lit(0.0)) / 50.0,
            lambda: F.col("adr") / 200.0,
            lambda: F.coalesce(F.col("stays_in_week_nights").cast("double"), F.lit(0.0)) / 5.0]
_X_SQL = ["coalesce(lead_time, 0.0) / 50.0", "adr / 200.0",
          "coalesce(CAST(stays_in_week_nights AS DOUBLE), 0.0) / 5.0"]


def _small_features(spark, sf) -> DataFrame:
    return labeled(spark, sf).select("row_id", "label", F.array(*[f() for f in _X_SPARK]).alias("features"))


def _objective_sql() -> str:
    parts = []
    for j, w in enumerate(W_FIXED):
        m = " + ".join(f"{float(w[t])!r} * x{t}" for t in range(3)) + f" + {float(w[3])!r}"
        y = f"CASE WHEN label = {j} THEN 1.0 ELSE -1.0 END"
        reg = 0.5 * float(w @ w)
        gs = ", ".join(f"round({float(w[t])!r} + 2 * sum(CASE WHEN 1 - ({y}) * ({m}) > 0 THEN (({m}) - ({y})) * x{t} ELSE 0 END), 6) AS g{t}"
                       for t in range(3))
        gb = f"round({float(w[3])!r} + 2 * sum(CASE WHEN 1 - ({y}) * ({m}) > 0 THEN ({m}) - ({y}) ELSE 0 END), 6) AS g3"
        parts.append(f"SELECT {j} AS class, round({reg!r} + sum(CASE WHEN 1 - ({y}) * ({m}) > 0 "
                     f"THEN (1 - ({y}) * ({m})) * (1 - ({y}) * ({m})) ELSE 0 END), 6) AS f, {gs}, {gb} FROM x")
    xs = ", ".join(f"{e} AS x{t}" for t, e in enumerate(_X_SQL))
    return with_bookings(LABELED_CTE, f"x AS (SELECT row_id, label, {xs} FROM labeled)") + " UNION ALL ".join(parts)


@register("svm_objective_at_w", _objective_sql(), "2.10")
def svm_objective_at_w(spark, sf):
    """Squared-hinge objective and gradient of the 3 one-vs-rest problems at a
    fixed W: the distributed partial-sum job used by every Newton iteration."""
    f, g = linear.loss_grad_at(_small_features(spark, sf), W_FIXED, CLASSES, 1.0)
    rows = [(j, round(float(f[j]), 6), *[round(float(v), 6) for v in g[j]]) for j in range(3)]
    return spark.createDataFrame(rows, "class int, f double, g0 double, g1 double, g2 double, g3 double")


def _score_sql() -> str:
    xs = ", ".join(f"{e} AS x{t}" for t, e in enumerate(_X_SQL))
    decs = [" + ".join(f"{float(w[t])!r} * x{t}" for t in range(3)) + f" + {float(w[3])!r}" for w in W_FIXED]
    return with_bookings(LABELED_CTE, f"x AS (SELECT row_id, label, {xs} FROM labeled)") + f"""
SELECT row_id, CAST(CASE WHEN d0 >= d1 AND d0 >= d2 THEN 0 WHEN d1 >= d2 THEN 1 ELSE 2 END AS INTEGER) AS prediction,
       d0, d1, d2
FROM (SELECT row_id, {decs[0]} AS d0, {decs[1]} AS d1, {decs[2]} AS d2 FROM x)"""


@register("score_linear", _score_sql(), "2.10")
def score_linear(spark, sf):
    """Linear decision values and argmax with broadcast weights (no UDF)."""
    m = linear.LinearSVMModel(W_FIXED, list(CLASSES))
    out = m.transform(_small_features(spark, sf))
    # same operation order in both engines: compared unrounded
    return out.select("row_id", "prediction", *[F.col("decision")[j].alias(f"d{j}") for j in range(3)])


# --------------------------------------------------------------------------
# sparse assembly and the Hessian-free fit
# --------------------------------------------------------------------------

def _assemble_sql() -> str:
    words = " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS col, {c} AS value FROM split WHERE is_train AND {c} IS NOT NULL" for c in BOOKING_STRING)
    dic = f"dic AS (SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY md5(value)) - 1 AS code FROM ({words}))"
    parts = [f"SELECT row_id, CAST({k} AS BIGINT) AS slot, round(CAST({c} AS DOUBLE), 6) AS value FROM split WHERE {c} <> 0"
             for k, c in enumerate(BOOKING_NUMERIC)]
    for k, c in enumerate(BOOKING_STRING):
        before = ", ".join(f"'{x}'" for x in BOOKING_STRING[:k]) or "''"
        parts.append(f"SELECT row_id, CAST({len(BOOKING_NUMERIC)} + (SELECT count(*) FROM dic WHERE col IN ({before})) + code AS BIGINT) AS slot, "
                     f"CAST(1 AS DOUBLE) AS value FROM split JOIN dic ON col = '{c}' AND dic.value = split.{c}")
    return with_bookings(LABELED_CTE, SPLIT_CTE, dic) + " UNION ALL ".join(parts)


@register("tx_assemble", _assemble_sql(), "2.7")
def tx_assemble(spark, sf):
    """Sparse rows of all numeric and category columns, one line per entry; the dictionary is that of the training part."""
    df = reuse(with_split(labeled(spark, sf)))
    rows, _ = sparse.assemble_sparse(df, ["row_id"], BOOKING_NUMERIC, *category_codes(df.where("is_train"), BOOKING_STRING))
    entry = F.explode(F.arrays_zip("indices", "values")).alias("e")
    return rows.select("row_id", entry).select("row_id", F.col("e.indices").alias("slot"), F.round("e.values", 6).alias("value"))


@register("fit_svm_sparse", None, "2.8")
def fit_svm_sparse(spark, sf):
    """Truncated Newton on sparse rows (scaled numbers, all categories), balanced class weights; test predictions."""
    tr, te = train_test(spark, sf)
    scale = Scaler(False, BOOKING_NUMERIC).fit(tr)
    codes, sizes = category_codes(tr, BOOKING_STRING)
    rows, width = sparse.assemble_sparse(scale.apply(tr), ["row_id", "label"], BOOKING_NUMERIC, codes, sizes)
    rows = reuse(rows)
    model = sparse.fit_sqhinge_sparse(rows, width, CLASSES, 1.0, linear.balanced_class_weights(rows, "label", CLASSES))
    rows.unpersist()
    test, _ = sparse.assemble_sparse(scale.apply(te), ["row_id"], BOOKING_NUMERIC, codes, sizes)
    return sparse.score_sparse(test, model).withColumn("converged", F.lit(model.converged))


# --------------------------------------------------------------------------
# the SVM compositions (load + predict), rows-only checks
# --------------------------------------------------------------------------

def _model_query(name: str):
    def build(spark, sf):
        tr, te = train_test(spark, sf)
        pred, _ = P.run_model(name, tr, te)
        return pred
    build.__doc__ = f"SVM composition {name}: select on 80/20 of train, refit, predict test."
    return build


for _name in P.MODELS:
    register(f"model_{_name}", None, "2.14")(_model_query(_name))


def _trials(spark, name: str, phases) -> DataFrame:
    """(model, phase, candidate, parameters, f1, converged, chosen) of every trial."""
    rows = []
    for phase, trials in phases:
        chosen = P.best_of(trials)
        for i, t in enumerate(trials):
            p, c = t.candidate.prep, t.candidate.clf
            lo, hi, thresh = p.skew or (None, None, None)
            rows.append((name, phase, i, c.C, c.sample_alpha if c.sample_alpha is not None else c.alpha, c.loss, c.penalty, p.use_total_cost, p.use_prev_ratio,
                         lo, hi, thresh, p.min_frequency, round(t.f1, 6), t.converged, i == chosen))
    return spark.createDataFrame(rows, "model string, phase string, candidate int, C double, alpha double, loss string, penalty string, use_total_cost boolean, "
                                       "use_prev_ratio boolean, p_low double, p_high double, skew double, min_frequency int, f1 double, converged boolean, chosen boolean")


@register("sel_grid", None, "2.11")
def sel_grid(spark, sf):
    """Grid selection of composition E12: every candidate with its validation F1, the first best chosen."""
    return _trials(spark, "E12", P.select_model("E12", train_test(spark, sf)[0])[1])


@register("sel_two_phase", None, "2.11")
def sel_two_phase(spark, sf):
    """Two-phase selection of composition E14: features first, then C with the features fixed."""
    return _trials(spark, "E14", P.select_model("E14", train_test(spark, sf)[0])[1])


@register("fit_svm_sqhinge_l2", None, "2.10")
def fit_svm_sqhinge_l2(spark, sf):
    tr, te = train_test(spark, sf)
    return P.fit_and_predict(tr, te, P.Candidate(P.Prep(), P.Clf()))


@register("fit_svm_hinge_l2", None, "2.10")
def fit_svm_hinge_l2(spark, sf):
    tr, te = train_test(spark, sf)
    return P.fit_and_predict(tr, te, P.Candidate(P.Prep(min_frequency=10), P.Clf(loss="hinge")))


@register("fit_svm_l1", None, "2.10")
def fit_svm_l1(spark, sf):
    tr, te = train_test(spark, sf)
    return P.fit_and_predict(tr, te, P.Candidate(P.Prep(min_frequency=10), P.Clf(penalty="l1")))


# --------------------------------------------------------------------------
# notebook features: router -> target encoding / dummies -> standardise
# --------------------------------------------------------------------------

class NBFeatures:
    """Fitted on a training frame; ``apply`` gives (row_id, label, features).  The encoded training rows, which
    every statistic reads, are kept."""

    def __init__(self, train: DataFrame, te_cols, oh_cols):
        self.train = train
        self.te = TargetEncoder(te_cols, "label").fit(train)
        self.oh = OneHot(drop_first=True, columns=oh_cols).fit(train) if oh_cols else None
        self.encoded = x = reuse(self._encoded(train))
        self.num = [c for c in stats.numeric_columns(x) if c not in ("row_id", "label")]
        self.imp = ImputeMedian(self.num).fit(x)
        self.num = [c for c in self.num if c not in self.imp.dropped]
        self.sc = Scaler(True, self.num).fit(self.imp.apply(x))

    def _encoded(self, df: DataFrame) -> DataFrame:
        x = self.te.apply(df)
        if self.oh is not None:
            x = self.oh.apply(x)
        return x

    @property
    def n_features(self) -> int:
        return len(self.num)

    def apply(self, df: DataFrame) -> DataFrame:
        x = self.sc.apply(self.imp.apply(self.encoded if df is self.train else self._encoded(df)))
        keep = [c for c in ("row_id", "label", "fold", "is_val") if c in df.columns]
        return x.select(*keep, F.array(*[F.col(c).cast("double") for c in self.num]).alias("features"))


def nb_features(spark, sf):
    rows, tr, te = rows_train_test(spark, sf)
    te_cols, oh_cols = route_columns(rows, BOOKING_STRING)  # on full data, as the reference
    fe = NBFeatures(tr, te_cols, oh_cols)
    return fe.apply(tr).persist(StorageLevel.MEMORY_AND_DISK), fe.apply(te), (te_cols, oh_cols)


def _width(frame: DataFrame) -> int:
    return len(frame.select("features").first()[0])


def _scored(model, test: DataFrame) -> DataFrame:
    s = model.transform(test)
    return s.select("row_id", *[F.round(F.col("probability")[j], 6).alias(f"p_{j}") for j in CLASSES],
                    "prediction")


@register("fit_logreg", None, "2.10")
def fit_logreg(spark, sf):
    tr, te, _ = nb_features(spark, sf)
    return _scored(trees.fit_logreg(tr, 1000), te)


@register("fit_random_forest", None, "2.10")
def fit_random_forest(spark, sf):
    tr, te, _ = nb_features(spark, sf)
    return _scored(trees.fit_forest(tr, 100, 10), te)


@register("fit_extra_trees", None, "2.10")
def fit_extra_trees(spark, sf):
    """Re-aimed: 200 unbootstrapped trees, sqrt feature subsets."""
    tr, te, _ = nb_features(spark, sf)
    return _scored(trees.fit_forest(tr, 200, 10, bootstrap=False), te)


@register("fit_boosted_trees", None, "2.10")
def fit_boosted_trees(spark, sf):
    """Histogram boosting with a softmax loss: 200 iterations, depth 8, 31 leaves, step 0.1."""
    tr, te, _ = nb_features(spark, sf)
    return _scored(fit_boosting(tr, Boosting(n_iter=200, max_depth=8, step=0.1), _width(tr))[0], te)


@register("fit_boosted_even", None, "2.10")
def fit_boosted_even(spark, sf):
    """The symmetric-tree configuration: 200 iterations, depth 6, step 0.1, leaf penalty 3."""
    tr, te, _ = nb_features(spark, sf)
    return _scored(fit_boosting(tr, S.EVEN, _width(tr))[0], te)


@register("fit_native_categorical", None, "2.10")
def fit_native_categorical(spark, sf):
    """Boosting on raw categories (100 iterations, depth 7, 31 leaves): a node orders its categories by gradient over
    hessian and cuts the order; unseen categories and nulls take the default side, missing numbers the
    better one."""
    tr, te = train_test(spark, sf)
    codes, sizes = category_codes(tr, BOOKING_STRING)

    def feats(df):
        x = with_codes(df, codes, BOOKING_STRING)
        return x.select("row_id", "label", F.array(*[F.col(c).cast("double") for c in [*BOOKING_NUMERIC, *[f"{c}__code" for c in BOOKING_STRING]]]).alias("features"))
    native = {len(BOOKING_NUMERIC) + k: sizes[c] for k, c in enumerate(BOOKING_STRING)}
    model = fit_boosting(feats(tr), Boosting(n_iter=100, max_depth=7, step=0.1), len(BOOKING_NUMERIC) + len(native), categorical=native)[0]
    return _scored(model, feats(te))


@register("score_proba", None, "2.10")
def score_proba(spark, sf):
    """Class-probability scoring of a fitted model as a long table."""
    tr, te, _ = nb_features(spark, sf)
    s = trees.fit_logreg(tr, 1000).transform(te)
    return s.select("row_id", F.posexplode("probability").alias("class", "p")) \
        .select("row_id", F.col("class").cast("int"), F.round("p", 6).alias("p"))


def _rbf_sql(n_comp: int = 300, gamma: float = 0.5) -> str:
    from ..operators.rff import hashed_weights_sql
    from . import sqlgen
    num = BOOKING_NUMERIC
    med = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}" for c in num)
    imp = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT {c} FROM med)) AS {c}" for c in num)
    st = ", ".join(f"avg({c}) AS {c}__mu, stddev_pop({c}) AS {c}__sd" for c in num)
    xs = " UNION ALL ".join(
        f"SELECT row_id, {j} AS j, (coalesce(CAST({c} AS DOUBLE), (SELECT {c} FROM med)) - (SELECT {c}__mu FROM st)) / "
        f"(SELECT CASE WHEN {c}__sd IS NULL OR {c}__sd = 0 THEN 1.0 ELSE {c}__sd END FROM st) AS x FROM te"
        for j, c in enumerate(num))
    ctes = [LABELED_CTE, sqlgen.stratified_split_cte("sp", "labeled"),
            "tr AS (SELECT * FROM sp WHERE NOT is_val)", "te AS (SELECT * FROM sp WHERE is_val)",
            f"med AS (SELECT {med} FROM tr)", f"imp AS (SELECT {imp} FROM tr)", f"st AS (SELECT {st} FROM imp)",
            f"xl AS ({xs})", *hashed_weights_sql(len(num), n_comp, gamma, 42),
            f"z AS (SELECT xl.row_id, w.k, sqrt({2.0 / n_comp!r}) * cos(sum(xl.x * w.w) + b.b) AS z "
            f"FROM xl JOIN rff_w w ON xl.j = w.j JOIN rff_b b ON w.k = b.k GROUP BY xl.row_id, w.k, b.b)"]
    return with_bookings(*ctes) + (f"SELECT row_id, CAST({n_comp} AS INTEGER) AS n_components, "
                                   "round(sum(z), 6) AS z_sum, round(sum(z * z), 6) AS z_sumsq FROM z GROUP BY row_id")


@register("tx_rbf_features", _rbf_sql(), "2.6")
def tx_rbf_features(spark, sf):
    """Random Fourier features (300 components, gamma 0.5) of the standardised
    numeric columns, fitted on the train part, applied to the test part; per
    row the number of components, their sum and sum of squares."""
    tr, te = train_test(spark, sf)
    num = BOOKING_NUMERIC
    med = ImputeMedian(num).fit(tr)
    sc = Scaler(True, num).fit(med.apply(tr))
    rff = RandomFourierFeatures(len(num), 300, 0.5, seed=42)
    x = sc.apply(med.apply(te)).select("row_id", F.array(*[F.col(c).cast("double") for c in num]).alias("x"))
    z = rff.transform(x, "x", "z")
    return z.select("row_id", F.size("z").alias("n_components"),
                    r6(F.aggregate("z", F.lit(0.0), lambda a, v: a + v), "z_sum"),
                    r6(F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v), "z_sumsq"))


# --------------------------------------------------------------------------
# stacking: out-of-fold base predictions -> meta learner
# --------------------------------------------------------------------------

FOLDS = 5


def _bases(spark, sf, with_test: bool) -> DataFrame:
    """Scores of the five bases: of the training part out of fold and, if wanted, of the test part by every model."""
    rows, tr, te = rows_train_test(spark, sf)
    te_cols, oh_cols = route_columns(rows, BOOKING_STRING)
    kf = stratified_kfold(tr, "label", FOLDS, 42)
    return S.base_scores(kf, te if with_test else None, te_cols, oh_cols, FOLDS)


@register("ens_oof_matrix", None, "2.11")
def ens_oof_matrix(spark, sf):
    """Class probabilities of five base learners for every training row, each from the model of the other folds."""
    return S.oof_rows(_bases(spark, sf, False))


@register("fit_meta_learner", None, "2.10")
def fit_meta_learner(spark, sf):
    """Boosted meta learner on the out-of-fold matrix (300 iterations, step 0.05, depth 5, leaf penalty 0.1,
    early stopping on a tenth): scores of its own rows, ``held_out`` marking those it stopped on."""
    oof = S.oof_rows(_bases(spark, sf, False))
    rows = S.tenth(S.meta_features(oof)).withColumnRenamed("is_valid", "held_out")
    s = S.fit_meta(oof).transform(rows)
    return s.select("row_id", "held_out", *[F.round(F.col("probability")[j], 6).alias(f"p_{j}") for j in CLASSES], "prediction")


@register("ens_stack_score", None, "2.11")
def ens_stack_score(spark, sf):
    """Held-out stacking score: test rows by the bases fitted on the whole training part, then by the meta learner."""
    scores = _bases(spark, sf, True)
    meta = S.fit_meta(S.oof_rows(scores))
    return _scored(meta, S.meta_features(S.test_rows(scores).filter(F.col("model") == FOLDS)).drop("model"))


@register("ens_fold_test_scores", None, "2.11")
def ens_fold_test_scores(spark, sf):
    """Test scores of the stack by fold: the meta learner over each fold's bases, and over those of the whole training
    part (fold null): log-loss and weighted F1 with mean and population deviation over the folds."""
    scores = _bases(spark, sf, True)
    meta = S.fit_meta(S.oof_rows(scores))
    s = meta.transform(S.meta_features(S.test_rows(scores))).withColumn("fold", F.when(F.col("model") < FOLDS, F.col("model")))
    s = cut_lineage(s.select("fold", "label", "prediction", p_true_from_array("probability", "label").alias("p")))
    loss = s.groupBy("fold").agg(F.avg(-F.log(prob_clip("p"))).alias("log_loss"))
    f1 = per_class_f1_grouped(s, "label", "prediction", ["fold"]).groupBy("fold").agg((F.sum(F.col("support") * F.col("f1")) / F.sum("support")).alias("f1_weighted"))
    both = cut_lineage(loss.join(f1, loss["fold"].eqNullSafe(f1["fold"])).select(loss["fold"], "log_loss", "f1_weighted"))
    folds = both.filter("fold is not null")
    over = folds.agg(*[f(c).alias(f"{c}_{n}") for c in ("log_loss", "f1_weighted") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    return both.crossJoin(F.broadcast(over)).select("fold", *[F.round(c, 6).alias(c) for c in ("log_loss", "f1_weighted", *over.columns)])
