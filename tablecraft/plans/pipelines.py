"""The 14 linear-SVM compositions, grid selection and the submission flow.

A pipeline = feature stages (domain, temporal, skew clip+log) -> column
transformer (numeric: median impute + scale [+ random Fourier features];
categorical: mode impute + one-hot) -> ``features`` array -> classifier.

Every stage is fitted with one aggregation on the training part and applied
lazily.  Grid candidates that share a preprocessing spec share one fitted and
persisted feature frame (the reference refits it per candidate) and one chain of Newton passes
that carries them all; preprocessings run side by side from driver threads.
Selection maximises weighted F1 on a stratified 80/20 split (strict ``>``, so
the first best candidate wins), then the winner is refitted on all rows.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, replace
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.domain import hotel_features
from ..functions.temporal import temporal_features
from ..operators import linear, stats
from ..operators.metrics import f1_weighted
from ..operators.rff import RandomFourierFeatures
from ..operators.sampling import in_tasks, oversample, stratified_split
from ..operators.transforms import ImputeMode, ImputeState, OneHot, Scaler, SkewClipLog
from ..session import cut_lineage

CLASSES = [0, 1, 2]
RESERVED = {"row_id", "label", "weight", "fold", "is_val", "is_train", "draw"}


@dataclass(frozen=True)
class Prep:
    domain: bool = False
    use_total_cost: bool = True
    use_prev_ratio: bool = True
    temporal: bool = False
    cyclical: bool = False
    use_season: bool = True
    skew: tuple | None = None          # (p_low, p_high, thresh)
    with_mean: bool = False
    min_frequency: int | None = None
    drop_if_binary: bool = False
    use_cats: bool = True
    rff: tuple | None = None           # (n_components, gamma)


@dataclass(frozen=True)
class Clf:
    C: float = 1.0
    loss: str = "squared_hinge"        # or "hinge"
    penalty: str = "l2"                # or "l1"
    balanced: bool = True
    alpha: float = 1.0                 # class-2 multiplier (class weight)
    sample_alpha: float | None = None  # E5: balanced row weights x alpha on class 2
    oversample: float | None = None    # E6: ratio n2 / n0
    max_iter: int = 1000


@dataclass
class FittedPrep:
    spec: Prep
    steps: list
    num_cols: list[str]
    ohe: object | None
    rff: object | None
    n_features: int

    def release(self) -> None:
        """Drops the cached tables of the fit."""
        if self.ohe is not None:
            self.ohe.release()

    def features(self, df: DataFrame) -> DataFrame:
        """(row_id, label?, weight?, features array<double>)."""
        x = _feature_stages(df, self.spec)
        for st in self.steps:
            x = st.apply(x)
        num = [F.col(c).cast("double") for c in self.num_cols]
        keep = [c for c in ("row_id", "label", "weight") if c in df.columns]
        if self.rff is not None:
            x = x.withColumn("_num", F.array(*num) if num else F.array().cast("array<double>"))
            x = self.rff.transform(x, "_num", "_rff")
            parts = [F.col("_rff")]
        else:
            parts = [F.array(*num)] if num else []
        if self.ohe is not None and self.ohe.categories:
            x = self.ohe.apply_codes(x)
            for c, cats in self.ohe.categories.items():
                code = F.col(f"{c}__code")
                parts.append(F.array(*[F.coalesce((code == i).cast("double"), F.lit(0.0))
                                       for i in range(len(cats))]))
        feats = F.concat(*parts) if len(parts) > 1 else parts[0]
        return x.select(*keep, feats.alias("features"))


def _feature_stages(df: DataFrame, p: Prep) -> DataFrame:
    x = df
    if p.domain:
        x = hotel_features(x, p.use_total_cost, p.use_prev_ratio)
    if p.temporal:
        x = temporal_features(x, p.cyclical, p.use_season)
    return x


def fit_prep(train: DataFrame, p: Prep) -> FittedPrep:
    return fit_preps(train, [p])[0]


def fit_preps(train: DataFrame, preps: Sequence[Prep]) -> list[FittedPrep]:
    """Several preprocessings of the same rows.  What they have in common is measured once: profiles and quantiles of
    a column, moments of a column under one rule, category counts.  Those whose features of one name may differ are fitted apart."""
    families: dict = {}
    for i, p in enumerate(preps):
        families.setdefault((p.domain, p.temporal, p.cyclical, p.use_season), []).append(i)
    out: dict[int, FittedPrep] = {}
    for at in families.values():
        out.update(zip(at, _fit_family(train, [preps[i] for i in at])))
    return [out[i] for i in range(len(preps))]


MOMENTS_PER_JOB = 40
HESSIAN_BYTES = 48 << 20   # of the preprocessings that are fitted side by side


def _fit_family(train: DataFrame, preps: Sequence[Prep]) -> list[FittedPrep]:
    """``fit_preps`` of preprocessings whose columns of one name are equal."""
    widest = replace(preps[0], use_total_cost=any(p.use_total_cost for p in preps), use_prev_ratio=any(p.use_prev_ratio for p in preps))
    x = _feature_stages(train, widest)
    frames = [_feature_stages(train, p) for p in preps]
    num_of = [stats.numeric_columns(f, RESERVED) for f in frames]
    cat_of = [stats.string_columns(f, RESERVED) if p.use_cats else [] for f, p in zip(frames, preps)]
    num = [c for c in stats.numeric_columns(x, RESERVED) if any(c in n for n in num_of)]

    skews = [SkewClipLog(*p.skew) if p.skew is not None else None for p in preps]
    seen = stats.column_profile(x, num) if any(s is not None for s in skews) else None
    probs = sorted({0.5}.union(*[s.probs for s in skews if s is not None]))
    between = stats.quantile_neighbours(x, num, probs, counts=None if seen is None else {c: seen[c]["n"] for c in num})

    def quantile(c: str, q: float):
        return between[c][probs.index(q)]
    rules: list[dict] = []
    states: list = []
    for s, cols in zip(skews, num_of):
        states.append(s.from_stats(seen, {c: [stats.interpolate(quantile(c, q)) for q in s.probs] for c in cols}) if s is not None else None)
        rules.append({c: states[-1].rules.get(c) if s is not None else None for c in cols})

    # the median of a column under a monotone rule lies between the rule's values at its neighbours
    pairs = list(dict.fromkeys((c, r) for rs in rules for c, r in rs.items()))
    ruled = [(c, r) for c, r in pairs if r is not None and quantile(c, 0.5) is not None]
    moved = train.sparkSession.range(1).select(F.array([r.of(F.lit(v)) for c, r in ruled for v in quantile(c, 0.5)[:2]]).alias("v")).first()["v"] if ruled else []
    median = {}
    for c, r in pairs:
        m = quantile(c, 0.5)
        if m is not None and r is not None:
            i = 2 * ruled.index((c, r))
            m = (moved[i], moved[i + 1], m[2])
        median[c, r] = stats.interpolate(m)

    moments: dict = {}
    known = [k for k in pairs if median[k] is not None]
    for i in range(0, len(known), MOMENTS_PER_JOB):
        some = known[i:i + MOMENTS_PER_JOB]
        filled = x.select(*[F.coalesce(F.col(c).cast("double") if r is None else r.of(c), F.lit(median[c, r])).alias(f"m{j}") for j, (c, r) in enumerate(some)])
        found = stats.mean_std(filled, filled.columns)
        moments.update({k: found[f"m{j}"] for j, k in enumerate(some)})

    cats: dict = {}
    for p, cols in zip(preps, cat_of):
        key = (tuple(cols), p.min_frequency, p.drop_if_binary)
        if cols and key not in cats:
            same = [v for k, v in cats.items() if k[0] == key[0]]
            mode = same[0][0] if same else ImputeMode(cols).fit(x)
            kept = [c for c in cols if c not in mode.dropped]
            cats[key] = mode, OneHot(p.min_frequency, p.drop_if_binary, False, kept).fit(mode.apply(x))

    out = []
    for p, cols, cat, rs, skew in zip(preps, num_of, cat_of, rules, states):
        fill = {c: median[c, rs[c]] for c in cols}
        imp = ImputeState({c: float(v) for c, v in fill.items() if v is not None}, [c for c, v in fill.items() if v is None], as_double=True)
        cols = [c for c in cols if c not in imp.dropped]
        steps = [*([skew] if skew is not None else []), imp, Scaler(p.with_mean, cols).from_stats({c: moments[c, rs[c]] for c in cols})]
        mode, ohe = cats[tuple(cat), p.min_frequency, p.drop_if_binary] if cat else (None, None)
        if mode is not None:
            steps.append(mode)
        rff, width = None, len(cols)
        if p.rff is not None:
            rff, width = RandomFourierFeatures(len(cols), p.rff[0], p.rff[1], seed=42), p.rff[0]
        n_ohe = sum(len(v) for v in ohe.categories.values()) if ohe is not None else 0
        out.append(FittedPrep(p, steps, cols, ohe, rff, width + n_ohe))
    return out


def fit_classifier(feats: DataFrame, n_features: int, clf: Clf, label: str = "label"):
    if clf.loss == "hinge":
        return _fit_hinge_ovr(feats, clf)
    weight = None
    cw = None
    if clf.sample_alpha is not None:
        weight = "weight"
        rw = linear.balanced_class_weights(feats, label, CLASSES)
        m = F.create_map(*[x for c, w in zip(CLASSES, rw) for x in (F.lit(c), F.lit(w))])
        feats = feats.withColumn("weight", m[F.col(label)] *
                                 F.when(F.col(label) == 2, F.lit(clf.sample_alpha)).otherwise(1.0))
    elif clf.balanced:
        cw = linear.balanced_class_weights(feats, label, CLASSES, {2: clf.alpha})
    if clf.penalty == "l1":
        return linear.fit_sqhinge_l1(feats, n_features, CLASSES, clf.C, cw, max_iter=clf.max_iter)
    return linear.fit_sqhinge_l2(feats, n_features, CLASSES, clf.C, cw, max_iter=clf.max_iter,
                                 weight=weight)


class _OvRHinge:
    """Spark ML LinearSVC (hinge, L2) one-vs-rest; regParam = 1 / (C * sum of weights)."""

    def __init__(self, models, classes):
        self.models, self.classes = models, classes

    def transform(self, df: DataFrame, feat: str = "features", out: str = "prediction") -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array
        x = df.withColumn("_v", array_to_vector(feat))
        for c, m in zip(self.classes, self.models):
            x = m.setFeaturesCol("_v").setRawPredictionCol(f"_raw{c}").setPredictionCol(f"_p{c}") \
                .transform(x).withColumn(f"_d{c}", vector_to_array(f"_raw{c}")[1]).drop(f"_raw{c}", f"_p{c}")
        dec = F.array(*[F.col(f"_d{c}") for c in self.classes])
        idx = F.array_position(dec, F.array_max(dec)).cast("int")
        return x.withColumn(out, F.element_at(F.array(*[F.lit(c) for c in self.classes]), idx).cast("int")) \
                .drop("_v", *[f"_d{c}" for c in self.classes])


def _fit_hinge_ovr(feats: DataFrame, clf: Clf):
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector
    counts = {r["label"]: r["count"] for r in feats.groupBy("label").count().collect()}   # one row per class
    n, k = sum(counts.values()), sum(1 for c in CLASSES if counts.get(c))
    # every fit plans its frame anew several times: from a short plan, not from all the expressions of the features
    x = cut_lineage(feats.select("label", array_to_vector("features").alias("_v")))

    def fit_one(c):
        # a class weight raises the class's own side only, as in the one-vs-rest reduction
        n_c = counts.get(c, 0)
        w = (n / (k * n_c) if clf.balanced and n_c else 1.0) * (clf.alpha if c == 2 and clf.balanced else 1.0)
        y = x.withColumn("_y", (F.col("label") == c).cast("double")) \
             .withColumn("_w", F.when(F.col("label") == c, F.lit(float(w))).otherwise(F.lit(1.0)))
        total = w * n_c + (n - n_c)
        return LinearSVC(featuresCol="_v", labelCol="_y", weightCol="_w", regParam=1.0 / (clf.C * total), maxIter=2000,
                         tol=1e-3, standardization=False).fit(y)

    with ThreadPoolExecutor(max_workers=len(CLASSES)) as ex:   # independent binary fits
        models = list(ex.map(fit_one, CLASSES))
    return _OvRHinge(models, CLASSES)


@dataclass
class Candidate:
    prep: Prep
    clf: Clf


def _train_rows(train: DataFrame, clf: Clf) -> DataFrame:
    if clf.oversample is not None:
        return oversample(train, "label", clf.oversample, 42).drop("draw")
    return train


@dataclass
class Trial:
    """A candidate with its validation score."""
    candidate: Candidate
    f1: float
    converged: bool


def costs_of(clf: Clf, label_counts: dict[int, int]):
    """Cost matrix of a squared-hinge candidate from the label counts of its training rows."""
    n, k = sum(label_counts.values()), sum(1 for c in CLASSES if label_counts.get(c))
    balanced = [n / (k * label_counts[c]) if label_counts.get(c) else 0.0 for c in CLASSES]
    if clf.sample_alpha is not None:
        return linear.row_costs(CLASSES, clf.C, [w * (clf.sample_alpha if c == 2 else 1.0) for c, w in zip(CLASSES, balanced)])
    if clf.balanced:
        return linear.class_costs(CLASSES, clf.C, [w * (clf.alpha if c == 2 else 1.0) for c, w in zip(CLASSES, balanced)])
    return linear.class_costs(CLASSES, clf.C)


def _evaluate_group(cands: Sequence[Candidate], fp: FittedPrep, rows: DataFrame, label_counts: dict[int, int], va: DataFrame) -> list[Trial]:
    """Candidates of one preprocessing: one feature frame, one chain of passes that carries all
    squared-hinge candidates, one scoring pass.  The frames are released at the end."""
    ftr, fva = fp.features(rows), fp.features(va)
    out: dict[int, Trial] = {}
    together = [i for i, c in enumerate(cands) if c.clf.loss == "squared_hinge" and c.clf.penalty == "l2"]
    alone = len(together) < len(cands)     # the others read the rows again; the passes pack them once
    if alone:
        ftr, fva = ftr.persist(StorageLevel.MEMORY_AND_DISK), fva.persist(StorageLevel.MEMORY_AND_DISK)
    if together:
        models = linear.fit_sqhinge_grid(ftr, fp.n_features, CLASSES, [costs_of(cands[i].clf, label_counts) for i in together],
                                         max_iter=max(cands[i].clf.max_iter for i in together))
        for i, m, table in zip(together, models, linear.confusions(fva, models)):
            out[i] = Trial(cands[i], linear.f1_of_confusion(table), m.converged)
    for i, c in enumerate(cands):
        if i not in out:
            model = fit_classifier(ftr, fp.n_features, c.clf)
            out[i] = Trial(c, f1_weighted(model.transform(fva), "label", "prediction"), getattr(model, "converged", True))
    if alone:
        ftr.unpersist()
        fva.unpersist()
    return [out[i] for i in range(len(cands))]


def evaluate(cands: Sequence[Candidate], tr: DataFrame, va: DataFrame, threads: int = 4) -> list[Trial]:
    """Weighted F1 on ``va`` of every candidate fitted on ``tr``, in order.  Preprocessings of the same rows are fitted
    together; their fits are independent chains of small jobs and share the cluster's free slots, at most ``threads`` at a time."""
    by_rows: dict = {}
    for i, c in enumerate(cands):
        by_rows.setdefault(c.clf.oversample, {}).setdefault(c.prep, []).append(i)

    def prepared(groups):
        rows = _train_rows(tr, cands[next(iter(groups.values()))[0]].clf)
        if rows is not tr:
            rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        return [(at, fp, rows, counts) for at, fp in zip(groups.values(), fit_preps(rows, list(groups)))]
    with ThreadPoolExecutor(max_workers=threads) as ex:
        jobs = [job for part in ex.map(prepared, by_rows.values()) for job in part]
    # the driver holds the Hessians of those that run side by side
    most = max((8 * len(at) * len(CLASSES) * (fp.n_features + 1) ** 2 for at, fp, _, _ in jobs), default=0)
    with ThreadPoolExecutor(max_workers=max(1, min(threads, HESSIAN_BYTES // max(1, most)))) as ex:
        parts = list(ex.map(lambda job: _evaluate_group([cands[i] for i in job[0]], *job[1:], va), jobs))
    for _, fp, rows, _ in jobs:
        fp.release()
        if rows is not tr:
            rows.unpersist()
    out = {i: t for (at, *_), ts in zip(jobs, parts) for i, t in zip(at, ts)}
    return [out[i] for i in range(len(cands))]


def best_of(trials: Sequence[Trial]) -> int:
    best = 0
    for i, t in enumerate(trials):
        if t.f1 > trials[best].f1:   # strict: the first best wins
            best = i
    return best


def select(cands: Sequence[Candidate], labeled: DataFrame, seed: int = 43) -> tuple[Candidate, list[Trial]]:
    with _parts(labeled, seed) as (tr, va):
        trials = evaluate(cands, tr, va)
    return cands[best_of(trials)], trials


@contextmanager
def _parts(labeled: DataFrame, seed: int = 43):
    """Training and validation rows of the selection, kept while they are in use."""
    n = labeled.count()
    sp = in_tasks(stratified_split(labeled, "label", 20, seed, n_rows=n), n).persist(StorageLevel.MEMORY_AND_DISK)
    yield sp.where(~F.col("is_val")).drop("is_val"), sp.where("is_val").drop("is_val")
    sp.unpersist()


def select_model(name: str, labeled: DataFrame) -> tuple[Candidate, list[tuple[str, list[Trial]]]]:
    """Winner of a composition's grid and, if it has one, of its second phase; the trials by phase."""
    cands = grid(name)
    if len(cands) == 1:
        return cands[0], []
    with _parts(labeled) as (tr, va):          # both phases on the same rows
        trials = evaluate(cands, tr, va)
        best, phases = cands[best_of(trials)], [("A", trials)]
        more = phase_b(name, best)
        if more:
            trials = evaluate(more, tr, va)
            best = more[best_of(trials)]
            phases.append(("B", trials))
    return best, phases


def fit_and_predict(labeled_train: DataFrame, test: DataFrame, cand: Candidate) -> DataFrame:
    rows = _train_rows(labeled_train, cand.clf)
    if rows is not labeled_train:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    fp = fit_prep(rows, cand.prep)
    ftr = fp.features(rows)
    if cand.clf.loss == "hinge":               # the others pack the rows once
        ftr = ftr.persist(StorageLevel.MEMORY_AND_DISK)
    model = fit_classifier(ftr, fp.n_features, cand.clf)
    return model.transform(fp.features(test)).select("row_id", "prediction")


# --------------------------------------------------------------------------
# the compositions (grids as in the reference modules)
# --------------------------------------------------------------------------

def _g(*cands) -> list[Candidate]:
    return list(cands)


def grid(name: str) -> list[Candidate] | tuple:
    base = Prep()
    mf10 = Prep(min_frequency=10)
    if name in ("B", "E2"):
        return _g(Candidate(base, Clf(C=1.0)))
    if name == "E3":
        return _g(*[Candidate(base, Clf(C=c)) for c in (0.1, 0.5, 1.0, 2.0, 5.0, 10.0)])
    if name == "E4":
        return _g(Candidate(mf10, Clf()), Candidate(mf10, Clf(loss="hinge")),
                  Candidate(mf10, Clf(penalty="l1")))
    if name == "E5":
        return _g(*[Candidate(mf10, Clf(balanced=False, sample_alpha=a))
                    for a in (1.0, 1.25, 1.5, 2.0, 3.0, 4.0)])
    if name == "E6":
        return _g(*[Candidate(mf10, Clf(C=c, balanced=False, oversample=r))
                    for r in (0.05, 0.10, 0.20) for c in (0.5, 1.0)])
    if name == "E7":
        return _g(*[Candidate(Prep(min_frequency=m, drop_if_binary=d), Clf())
                    for m in (None, 5, 10, 20) for d in (False, True)])
    if name == "E9":
        return _g(*[Candidate(Prep(skew=(pl, ph, sk), min_frequency=10), Clf())
                    for (pl, ph) in ((1.0, 99.0), (2.0, 98.0), (5.0, 95.0)) for sk in (0.8, 1.0, 1.5)])
    if name == "E10":
        return _g(*[Candidate(Prep(temporal=True, cyclical=cy, use_season=se, min_frequency=10), Clf())
                    for cy in (False, True) for se in (False, True)])
    if name == "E11":
        return _g(*[Candidate(Prep(domain=True, use_total_cost=t, use_prev_ratio=r, min_frequency=10), Clf())
                    for t in (False, True) for r in (False, True)])
    if name in ("E12", "E13", "E14"):
        cs = (0.5, 1.0, 2.0) if name != "E14" else (1.0,)
        return _g(*[Candidate(Prep(domain=True, use_total_cost=t, use_prev_ratio=r, skew=(pl, ph, 1.0),
                                   min_frequency=10), Clf(C=c))
                    for t in (False, True) for r in (False, True)
                    for (pl, ph) in ((1.0, 99.0), (2.0, 98.0)) for c in cs])
    if name == "E15":
        return _g(*[Candidate(Prep(domain=True, skew=(2.0, 98.0, 1.0), with_mean=True, use_cats=uc,
                                   min_frequency=10, rff=(n, g)), Clf(C=c))
                    for uc in (True, False) for n in (300, 600) for g in (0.5, 1.0, 2.0)
                    for c in (0.5, 1.0, 2.0)])
    raise KeyError(name)


def phase_b(name: str, best: Candidate) -> list[Candidate]:
    """Second selection phase with the phase-A winner fixed."""
    if name == "E13":
        return [Candidate(best.prep, replace(best.clf, alpha=a)) for a in (0.95, 1.0, 1.05, 1.1)]
    if name == "E14":
        return [Candidate(best.prep, replace(best.clf, C=c)) for c in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)]
    return []


MODELS = ("B", "E2", "E3", "E4", "E5", "E6", "E7", "E9", "E10", "E11", "E12", "E13", "E14", "E15")


def run_model(name: str, labeled_train: DataFrame, test: DataFrame) -> tuple[DataFrame, list]:
    """load + predict of one composition: select on an 80/20 split of the
    training rows, refit on all of them, score ``test``."""
    best, phases = select_model(name, labeled_train)
    return fit_and_predict(labeled_train, test, best), phases
