"""Queries for splits, sampling, weights (2.9), metrics and ensembles (2.11),
joins and stacking (2.7, 2.8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ensemble, metrics
from ..operators.sampling import (alpha_weight, balanced_weight, hash_int_sql, hash_key, hash_key_sql,
                                  hash_unit, oversample, random_split, stratified_kfold,
                                  stratified_split)
from ..operators.transforms import TargetEncoder
from ..functions.labels import label_to_int
from ..sources.bookings import bookings, with_bookings
from ..sources.tables import read_table
from ..streaming.online import expert_probs_projection
from . import sqlgen
from .common import LABELED_CTE, labeled, reuse, split_sql
from .experts import CLASSES, expert_long, expert_long_sql, oof_sql, oof_target_encode
from .registry import register

TE_COLS = ["country", "market_segment", "reserved_room_type"]
ETA = 0.5

# --------------------------------------------------------------------------
# 2.9 splits, folds, sampling, weights
# --------------------------------------------------------------------------


@register("split_stratified", with_bookings(LABELED_CTE, sqlgen.stratified_split_cte("sp", "labeled")) +
          "SELECT row_id, label, is_val FROM sp", "2.9")
def split_stratified(spark, sf):
    return stratified_split(labeled(spark, sf), "label", 20, 42).select("row_id", "label", "is_val")


@register("split_stratified_kfold", with_bookings(LABELED_CTE, sqlgen.kfold_cte("kf", "labeled")) +
          "SELECT row_id, label, fold FROM kf", "2.9")
def split_stratified_kfold(spark, sf):
    return stratified_kfold(labeled(spark, sf), "label", 5, 42).select("row_id", "label", "fold")


@register("split_fold_balance", with_bookings(LABELED_CTE, sqlgen.kfold_cte("kf", "labeled")) +
          "SELECT fold, label, count(*) AS n FROM kf GROUP BY fold, label", "2.9")
def split_fold_balance(spark, sf):
    """Invariant view: rows per (fold, class) — within one row across folds."""
    kf = stratified_kfold(labeled(spark, sf), "label", 5, 42)
    return kf.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))


@register("split_random", with_bookings(LABELED_CTE) +
          f"SELECT row_id, {split_sql(13, 0.8)} AS is_train FROM labeled", "2.9")
def split_random(spark, sf):
    return random_split(labeled(spark, sf), 0.8, 13).select("row_id", "is_train")


L3_CTE = "l3 AS (SELECT doc_id AS row_id, quality + toxic AS label FROM labels)"


def labels3(spark, sf) -> DataFrame:
    """Three imbalanced classes from ``labels``: quality + toxic (0, 1, 2)."""
    return read_table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"),
                                                  (F.col("quality") + F.col("toxic")).alias("label"))


def _oversample_sql(ratio: float, seed: int = 42) -> str:
    return f"""WITH {L3_CTE},
cnt AS (SELECT count_if(label = 0) AS n0, count_if(label = 2) AS n2 FROM l3),
plan AS (SELECT CAST(n2 AS BIGINT) AS n2, CAST(greatest(n2, CAST(round_even({ratio!r} * n0, 0) AS BIGINT)) - n2 AS BIGINT) AS extra FROM cnt),
minor AS (SELECT row_id, label, row_number() OVER (ORDER BY {hash_key_sql('row_id', seed)}) AS _r
          FROM l3 WHERE label = 2),
draws AS (SELECT i AS draw, {hash_int_sql(f"md5(CAST(i AS VARCHAR) || '#draw{seed}')")} % (SELECT n2 FROM plan) + 1 AS _r
          FROM (SELECT unnest(range(0, (SELECT extra FROM plan))) AS i))
SELECT row_id, label, CAST(NULL AS BIGINT) AS draw FROM l3
UNION ALL SELECT m.row_id, m.label, d.draw FROM minor m JOIN draws d ON m._r = d._r"""


@register("sample_oversample", _oversample_sql(0.2), "2.9")
def sample_oversample(spark, sf):
    """Class 2 oversampled with replacement to round_half_even(0.2 * n0)."""
    return oversample(labels3(spark, sf), "label", 0.2, 42).select("row_id", "label", "draw")


@register("sample_oversample_counts", " UNION ALL ".join(
    f"SELECT CAST({r!r} AS DOUBLE) AS ratio, label, count(*) AS n FROM ({_oversample_sql(r)}) GROUP BY label"
    for r in (0.05, 0.1, 0.2)), "2.9")
def sample_oversample_counts(spark, sf):
    l3 = labels3(spark, sf)
    outs = [oversample(l3, "label", r, 42).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(r).alias("ratio"), "label", "n") for r in (0.05, 0.1, 0.2)]
    return outs[0].unionByName(outs[1]).unionByName(outs[2])


@register("weight_balanced", f"""WITH {L3_CTE}
SELECT row_id, label, (count(*) OVER ()) / (3 * count(*) OVER (PARTITION BY label)) AS weight FROM l3""", "2.9")
def weight_balanced(spark, sf):
    return balanced_weight(labels3(spark, sf), "label", "weight", n_classes=3).select("row_id", "label", "weight")


@register("weight_alpha", f"""WITH {L3_CTE}
SELECT row_id, label, CASE WHEN label = 2 THEN w * 1.5 ELSE w END AS weight FROM (
  SELECT row_id, label, (count(*) OVER ()) / (3 * count(*) OVER (PARTITION BY label)) AS w FROM l3)""", "2.9")
def weight_alpha(spark, sf):
    b = balanced_weight(labels3(spark, sf), "label", "weight", n_classes=3)
    return alpha_weight(b, 1.5, "label", "weight").select("row_id", "label", "weight")


# --------------------------------------------------------------------------
# experts on a hold-out: 95/5 split, hold-out halved into online / test
# --------------------------------------------------------------------------

def holdout_frames(spark, sf):
    lab = labeled(spark, sf)
    s = reuse(lab.withColumn("is_train", hash_unit(hash_key("row_id", 13)) < F.lit(0.95))
              .withColumn("is_online", hash_unit(hash_key("row_id", 14)) < F.lit(0.5)))
    train = s.where("is_train")
    hold = s.where(~F.col("is_train"))
    return train, hold


HOLD_CTES = [LABELED_CTE,
             f"s AS (SELECT *, {split_sql(13, 0.95)} AS is_train, {split_sql(14, 0.5)} AS is_online FROM labeled)",
             "train AS (SELECT * FROM s WHERE is_train)", "hold AS (SELECT * FROM s WHERE NOT is_train)"]


def _hold_experts_sql(*more: str) -> str:
    return with_bookings(*HOLD_CTES, *expert_long_sql("train", "hold", TE_COLS), *more)


def hold_experts(spark, sf):
    train, hold = holdout_frames(spark, sf)
    return expert_long(train, hold, TE_COLS), hold


@register("ens_expert_probs", _hold_experts_sql() + "SELECT row_id, expert, class, p FROM experts", "2.11")
def ens_expert_probs(spark, sf):
    """Long matrix of expert probabilities on the hold-out."""
    long, _ = hold_experts(spark, sf)
    return long


_EXPERT_NAMES = ["prior"] + [f"te_{c}" for c in TE_COLS]


@register("join_hconcat", _hold_experts_sql() + "SELECT row_id, " + ", ".join(
    f"max(CASE WHEN expert = '{e}' AND class = {j} THEN p END) AS {e}_class{j}"
    for e in _EXPERT_NAMES for j in CLASSES) + " FROM experts GROUP BY row_id", "2.7")
def join_hconcat(spark, sf):
    """Experts side by side, keyed by row_id (explicit pivot values)."""
    long, _ = hold_experts(spark, sf)
    keyed = long.withColumn("ec", F.concat(F.col("expert"), F.lit("_class"), F.col("class").cast("string")))
    return keyed.groupBy("row_id").pivot("ec", [f"{e}_class{j}" for e in _EXPERT_NAMES for j in CLASSES]) \
        .agg(F.first("p"))


_AVG_SQL = """, avgp AS (SELECT e.row_id, e.class, sum(w.w * e.p) / sum(w.w) AS p
  FROM experts e JOIN hold h ON e.row_id = h.row_id AND NOT h.is_online
  JOIN (SELECT DISTINCT expert, 1.0 / 4 AS w FROM experts) w ON e.expert = w.expert
  GROUP BY e.row_id, e.class),
pred AS (SELECT row_id, CAST(-max({'p': p, 'nc': -class}).nc AS INTEGER) AS prediction FROM avgp GROUP BY row_id)"""


def _avg_sql(*more: str) -> str:
    return _hold_experts_sql() .rstrip() + _AVG_SQL + "".join(more) + "\n"


def uniform_test(spark, sf):
    long, hold = hold_experts(spark, sf)
    test_ids = hold.where(~F.col("is_online")).select("row_id")
    lt = long.join(test_ids, "row_id", "left_semi")
    avg = ensemble.weighted_average(lt, ensemble.uniform_weights(lt))
    pred = ensemble.argmax_long(avg)
    return avg, pred, hold


@register("ens_weighted_avg", _avg_sql() + """
SELECT a.row_id, a.class, round(a.p, 6) AS p, p.prediction FROM avgp a JOIN pred p ON a.row_id = p.row_id""", "2.11")
def ens_weighted_avg(spark, sf):
    """Uniform weighted average of the experts on the test half (EWA as
    shipped by the reference) with argmax prediction."""
    avg, pred, _ = uniform_test(spark, sf)
    return avg.join(pred, "row_id").select("row_id", "class", F.round("p", 6).alias("p"), "prediction")


def _scored_sql() -> str:
    return """, scored AS (SELECT p.row_id, h.label, p.prediction,
  (SELECT a.p FROM avgp a WHERE a.row_id = p.row_id AND a.class = h.label) AS p_true
  FROM pred p JOIN hold h ON p.row_id = h.row_id)"""


F1_SQL_BODY = """, cm AS (SELECT label AS y, prediction AS yhat, count(*) AS n FROM scored GROUP BY label, prediction),
pc AS (SELECT c.class, coalesce(s.support, 0) AS support, coalesce(pp.predicted, 0) AS predicted,
              coalesce(t.tp, 0) AS tp
  FROM (SELECT y AS class FROM cm UNION SELECT yhat FROM cm) c
  LEFT JOIN (SELECT y AS class, sum(n) AS support FROM cm GROUP BY y) s ON c.class = s.class
  LEFT JOIN (SELECT yhat AS class, sum(n) AS predicted FROM cm GROUP BY yhat) pp ON c.class = pp.class
  LEFT JOIN (SELECT y AS class, n AS tp FROM cm WHERE y = yhat) t ON c.class = t.class),
f1c AS (SELECT class, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted,
               CAST(tp AS BIGINT) AS tp,
               CASE WHEN tp > 0 THEN 2.0 * tp / (support + predicted) ELSE 0.0 END AS f1 FROM pc)"""


@register("met_f1_weighted", _avg_sql(_scored_sql(), F1_SQL_BODY) +
          "SELECT round(sum(support * f1) / sum(support), 6) AS f1_weighted FROM f1c", "2.11")
def met_f1_weighted(spark, sf):
    _, pred, hold = uniform_test(spark, sf)
    s = pred.join(hold.select("row_id", "label"), "row_id")
    return metrics.f1_weighted_df(s, "label", "prediction").select(F.round("f1_weighted", 6).alias("f1_weighted"))


@register("met_per_class_f1", _avg_sql(_scored_sql(), F1_SQL_BODY) +
          "SELECT class, support, predicted, tp, round(f1, 6) AS f1 FROM f1c", "2.11")
def met_per_class_f1(spark, sf):
    _, pred, hold = uniform_test(spark, sf)
    s = pred.join(hold.select("row_id", "label"), "row_id")
    return metrics.per_class_f1(s, "label", "prediction").select(
        "class", "support", "predicted", "tp", F.round("f1", 6).alias("f1"))


@register("met_log_loss", _avg_sql(_scored_sql()) +
          "SELECT round(avg(-ln(least(greatest(p_true, 1e-15), 1 - 1e-15))), 6) AS log_loss FROM scored", "2.11")
def met_log_loss(spark, sf):
    avg, pred, hold = uniform_test(spark, sf)
    pt = avg.join(hold.select("row_id", "label"), "row_id").where(F.col("class") == F.col("label"))
    return metrics.log_loss_df(pt.withColumnRenamed("p", "p_true"), "p_true") \
        .select(F.round("log_loss", 6).alias("log_loss"))


# EWA ---------------------------------------------------------------------------

_LOSS_SQL = f""", losses AS (SELECT e.row_id, e.expert, -ln(least(greatest(e.p, 1e-15), 1 - 1e-15)) AS loss
  FROM experts e JOIN hold h ON e.row_id = h.row_id AND h.is_online AND e.class = h.label)"""


@register("ens_ewa_weights", _hold_experts_sql().rstrip() + _LOSS_SQL + f"""
SELECT expert, round(cum_loss, 6) AS cum_loss, round(u / sum(u) OVER (), 6) AS weight FROM (
  SELECT expert, cum_loss, exp(-{ETA} * (cum_loss - min(cum_loss) OVER ())) AS u
  FROM (SELECT expert, sum(loss) AS cum_loss FROM losses GROUP BY expert))""", "2.11")
def ens_ewa_weights(spark, sf):
    """Final EWA weights (eta=0.5, uniform start) learned on the online half."""
    long, hold = hold_experts(spark, sf)
    losses = ensemble.expert_losses(long, hold.where("is_online"))
    w = ensemble.ewa_weights(losses, ETA)
    return w.select("expert", F.round("cum_loss", 6).alias("cum_loss"), F.round("weight", 6).alias("weight"))


@register("ens_ewa_trajectory", _hold_experts_sql().rstrip() + _LOSS_SQL + f"""
, cum AS (SELECT row_id, expert, sum(loss) OVER (PARTITION BY expert ORDER BY row_id
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS L FROM losses),
u AS (SELECT row_id, expert, exp(-{ETA} * (L - min(L) OVER (PARTITION BY row_id))) AS u FROM cum)
SELECT row_id, expert, round(u / sum(u) OVER (PARTITION BY row_id), 6) AS weight FROM u""", "2.11")
def ens_ewa_trajectory(spark, sf):
    """EWA weights after each online step (steps ordered by row_id)."""
    long, hold = hold_experts(spark, sf)
    losses = ensemble.expert_losses(long, hold.where("is_online")).withColumn("t", F.col("row_id"))
    tr = ensemble.ewa_trajectory(losses, "t", ETA, bucket_width=4096)
    return tr.select("row_id", "expert", F.round("weight", 6).alias("weight"))


@register("ens_ewa_test_metrics", _hold_experts_sql().rstrip() + _LOSS_SQL + f"""
, wts AS (SELECT expert, u / sum(u) OVER () AS w FROM (
  SELECT expert, exp(-{ETA} * (cum_loss - min(cum_loss) OVER ())) AS u
  FROM (SELECT expert, sum(loss) AS cum_loss FROM losses GROUP BY expert))),
avgp AS (SELECT e.row_id, e.class, sum(w.w * e.p) / sum(w.w) AS p
  FROM experts e JOIN hold h ON e.row_id = h.row_id AND NOT h.is_online
  JOIN wts w ON e.expert = w.expert GROUP BY e.row_id, e.class),
pred AS (SELECT row_id, CAST(-max({{'p': p, 'nc': -class}}).nc AS INTEGER) AS prediction FROM avgp GROUP BY row_id)
{_scored_sql()}{F1_SQL_BODY}
SELECT (SELECT count(*) FROM scored) AS n_test,
       (SELECT round(avg(-ln(least(greatest(p_true, 1e-15), 1 - 1e-15))), 6) FROM scored) AS log_loss,
       (SELECT round(sum(support * f1) / sum(support), 6) FROM f1c) AS f1_weighted""", "2.11")
def ens_ewa_test_metrics(spark, sf):
    """EWA-weighted aggregation of the experts scored on the test half."""
    long, hold = hold_experts(spark, sf)
    w = ensemble.ewa_weights(ensemble.expert_losses(long, hold.where("is_online")), ETA) \
        .select("expert", F.col("weight").alias("w"))
    lt = long.join(hold.where(~F.col("is_online")).select("row_id"), "row_id", "left_semi")
    avg = ensemble.weighted_average(lt, w)
    return _metrics_frame(avg, hold)


def _metrics_frame(avg: DataFrame, hold: DataFrame) -> DataFrame:
    """One row (n_test, log_loss, f1_weighted) from long averaged probs:
    one groupBy(row_id) gives prediction and p(true class), then one
    aggregate over the (at most k*k row) confusion table."""
    j = avg.join(hold.select("row_id", "label"), "row_id")
    per_row = j.groupBy("row_id", "label").agg(
        F.max(F.struct(F.col("p"), (-F.col("class")).alias("nc"))).alias("b"),
        F.sum(F.when(F.col("class") == F.col("label"), F.col("p"))).alias("p_true"))
    scored = per_row.select("label", (-F.col("b.nc")).cast("int").alias("prediction"),
                            (-F.log(F.least(F.greatest("p_true", F.lit(1e-15)), F.lit(1 - 1e-15)))).alias("loss"))
    return _confusion_metrics(scored)


def _confusion_metrics(scored: DataFrame) -> DataFrame:
    """One row (n_test, log_loss, f1_weighted) from (label, prediction, loss) rows."""
    cm = scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"), F.sum("loss").alias("ls"))
    n = F.sum("n")
    f1 = None
    for c in CLASSES:
        sup = F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0))
        prd = F.sum(F.when(F.col("prediction") == c, F.col("n")).otherwise(0))
        tp = F.sum(F.when((F.col("label") == c) & (F.col("prediction") == c), F.col("n")).otherwise(0))
        term = sup * F.when(tp > 0, 2.0 * tp / (sup + prd)).otherwise(0.0)
        f1 = term if f1 is None else f1 + term
    return cm.agg(n.alias("n_test"), F.round(F.sum("ls") / n, 6).alias("log_loss"),
                  F.round(f1 / n, 6).alias("f1_weighted"))


# --------------------------------------------------------------------------
# stacking: out-of-fold matrix (2.8 union_oof), fold summary
# --------------------------------------------------------------------------

def _oof_sql_prefix() -> list[str]:
    return [LABELED_CTE, sqlgen.kfold_cte("kf", "labeled"), *oof_sql("kf", TE_COLS)]


@register("union_oof", with_bookings(*_oof_sql_prefix()) + "SELECT * FROM oof", "2.8")
def union_oof(spark, sf):
    """Out-of-fold target encodings for all 5 folds, stacked (one pass)."""
    kf = stratified_kfold(labeled(spark, sf), "label", 5, 42)
    return oof_target_encode(kf, TE_COLS, "label", "fold")


_OOF_PRED_SQL = ", oofp AS (SELECT o.row_id, o.fold, k.label, " + \
    ", ".join(f"({' + '.join(f'o.{c}_{j}' for c in TE_COLS)}) / {len(TE_COLS)}.0 AS p_{j}" for j in CLASSES) + \
    " FROM oof o JOIN kf k ON o.row_id = k.row_id)" + \
    ", oofy AS (SELECT row_id, fold, label, CASE WHEN p_0 >= p_1 AND p_0 >= p_2 THEN 0 " \
    "WHEN p_1 >= p_2 THEN 1 ELSE 2 END AS prediction FROM oofp)"


def _oof_pred(spark, sf):
    kf = stratified_kfold(labeled(spark, sf), "label", 5, 42)
    oof = oof_target_encode(kf, TE_COLS, "label", "fold")
    probs = [sum(F.col(f"{c}_{j}") for c in TE_COLS) / float(len(TE_COLS)) for j in CLASSES]
    p = oof.join(kf.select("row_id", "label"), "row_id").select(
        "row_id", "fold", "label", *[x.alias(f"p_{j}") for j, x in enumerate(probs)])
    pred = F.when((F.col("p_0") >= F.col("p_1")) & (F.col("p_0") >= F.col("p_2")), 0) \
        .when(F.col("p_1") >= F.col("p_2"), 1).otherwise(2)
    return p.withColumn("prediction", pred)


def _fold_f1_sql() -> str:
    return """, fcm AS (SELECT fold, label AS y, prediction AS yhat, count(*) AS n FROM oofy GROUP BY ALL),
fsup AS (SELECT fold, y AS class, sum(n) AS support FROM fcm GROUP BY ALL),
fpred AS (SELECT fold, yhat AS class, sum(n) AS predicted FROM fcm GROUP BY ALL),
ftp AS (SELECT fold, y AS class, n AS tp FROM fcm WHERE y = yhat),
fcls AS (SELECT fold, class FROM fsup UNION SELECT fold, class FROM fpred),
ff1 AS (SELECT c.fold, c.class, coalesce(s.support, 0) AS support,
               CASE WHEN coalesce(t.tp, 0) > 0 THEN 2.0 * t.tp / (coalesce(s.support, 0) + coalesce(p.predicted, 0))
                    ELSE 0.0 END AS f1
        FROM fcls c LEFT JOIN fsup s USING (fold, class) LEFT JOIN fpred p USING (fold, class)
        LEFT JOIN ftp t USING (fold, class)),
fscore AS (SELECT fold, sum(support * f1) / sum(support) AS v FROM ff1 GROUP BY fold)"""


@register("met_fold_scores", with_bookings(*_oof_sql_prefix()) + _OOF_PRED_SQL + _fold_f1_sql() +
          "\nSELECT fold, round(v, 6) AS f1_weighted FROM fscore", "2.11")
def met_fold_scores(spark, sf):
    p = _oof_pred(spark, sf)
    return _fold_scores(p).select("fold", F.round("v", 6).alias("f1_weighted"))


def _fold_scores(p: DataFrame) -> DataFrame:
    t = metrics.per_class_f1_grouped(p, "label", "prediction", ["fold"])
    return t.groupBy("fold").agg((F.sum(F.col("support") * F.col("f1")) / F.sum("support")).alias("v"))


@register("met_fold_summary", with_bookings(*_oof_sql_prefix()) + _OOF_PRED_SQL + _fold_f1_sql() +
          "\nSELECT round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM fscore", "2.11")
def met_fold_summary(spark, sf):
    """Mean and population std of the per-fold weighted F1 (agg_mean_std_scores)."""
    s = _fold_scores(_oof_pred(spark, sf))
    return metrics.summary(s, "v").select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


# --------------------------------------------------------------------------
# flagship: stratified split -> experts fitted on train -> uniform average on
# the validation part -> log-loss and weighted F1
# --------------------------------------------------------------------------

def _flagship_sql() -> str:
    ctes = [LABELED_CTE, sqlgen.stratified_split_cte("sp", "labeled"),
            "train AS (SELECT * FROM sp WHERE NOT is_val)", "hold AS (SELECT *, FALSE AS is_online FROM sp WHERE is_val)",
            *expert_long_sql("train", "hold", TE_COLS)]
    return with_bookings(*ctes).rstrip() + _AVG_SQL + _scored_sql() + F1_SQL_BODY + """
SELECT (SELECT count(*) FROM scored) AS n_test,
       (SELECT round(avg(-ln(least(greatest(p_true, 1e-15), 1 - 1e-15))), 6) FROM scored) AS log_loss,
       (SELECT round(sum(support * f1) / sum(support), 6) FROM f1c) AS f1_weighted"""


@register("te_expert_holdout_metrics", _flagship_sql(), "2.11")
def te_expert_holdout_metrics(spark, sf):
    """Minimum end-to-end slice: label map, stratified 80/20 split, prior and
    smoothed target-encoding experts fitted on train, uniform aggregation on
    the validation part, argmax, log-loss and weighted F1."""
    sp = reuse(stratified_split(reuse(labeled(spark, sf)), "label", 20, 42))
    state = TargetEncoder(TE_COLS, "label", CLASSES).fit(sp.where(~F.col("is_val")))
    # the experts of a row stand side by side: average, argmax and loss are one projection
    scored = expert_probs_projection(sp.where("is_val").select("row_id", "label", *TE_COLS), state, "label")
    p_true = F.element_at(F.array(*[F.col(f"p_{j}") for j in CLASSES]), F.col("label") + 1)
    loss = -F.log(F.least(F.greatest(p_true, F.lit(1e-15)), F.lit(1 - 1e-15)))
    return _confusion_metrics(scored.select("label", "prediction", loss.alias("loss")))


# --------------------------------------------------------------------------
# 2.13 streaming forms of the online phase
# --------------------------------------------------------------------------

def _stream_score_sql() -> str:
    ctes = [LABELED_CTE, sqlgen.stratified_split_cte("sp", "labeled"),
            "train AS (SELECT * FROM sp WHERE NOT is_val)", "arrivals AS (SELECT * FROM sp WHERE is_val)",
            sqlgen.prior_cte("prior", "train"), *sqlgen.te_ctes("train", TE_COLS, "prior", prefix="enc_s"),
            f"wide AS ({sqlgen.te_apply('arrivals', TE_COLS, 'prior', prefix='enc_s')})"]
    ps = []
    for j in CLASSES:
        tail = f"{TE_COLS[0]}_{j}"
        for c in TE_COLS[1:]:
            tail = f"({tail} + {c}_{j})"
        ps.append(f"({sqlgen.prior_value('prior', j)} + {tail}) / {float(1 + len(TE_COLS))!r} AS p_{j}")
    return with_bookings(*ctes) + f"""SELECT row_id, p_0, p_1, p_2,
  CAST(CASE WHEN p_0 >= p_1 AND p_0 >= p_2 THEN 0 WHEN p_1 >= p_2 THEN 1 ELSE 2 END AS INTEGER) AS prediction
FROM (SELECT row_id, {', '.join(ps)} FROM wide)"""


@register("stream_score", _stream_score_sql(), "2.13")
def stream_score_q(spark, sf):
    """Validation bookings arrive as a file stream (4 micro-batches), are
    enriched by stream-static joins with the encodings fitted on the train
    part and scored; equals the batch scoring of the same rows."""
    from ..streaming.online import stream_score
    sp = reuse(stratified_split(reuse(labeled(spark, sf)), "label", 20, 42))
    st = TargetEncoder(TE_COLS, "label").fit(sp.where(~F.col("is_val")))
    arrivals = sp.where("is_val").select("row_id", *TE_COLS)
    return stream_score(spark, arrivals, st).select("row_id", "p_0", "p_1", "p_2", "prediction")


@register("sink_submission_scored", "SELECT row_id, prediction AS reservation_status FROM (" + _stream_score_sql() + ")", "2.1")
def sink_submission_scored(spark, sf):
    """CSV in, fit, score, CSV out: bookings are scanned from CSV, the experts are
    fitted on the train part, the other rows are scored and written as a keyed
    submission, which is read back."""
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..sources.sinks import read_submission, write_submission
    from ..sources.tables import read_csv
    from .catalog_basic import BOOKINGS_DDL
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/submission-{uuid.uuid4().hex}"
    bookings(spark, sf).write.option("header", "true").csv(f"{base}/in")
    rows = read_csv(spark, f"{base}/in", schema=BOOKINGS_DDL)
    rows = rows.withColumn("label", label_to_int("reservation_status")).drop("reservation_status")
    sp = reuse(stratified_split(rows, "label", 20, 42))
    state = TargetEncoder(TE_COLS, "label", CLASSES).fit(sp.where(~F.col("is_val")))
    scored = expert_probs_projection(sp.where("is_val").select("row_id", *TE_COLS), state)
    write_submission(scored, f"{base}/out")
    sp.unpersist()
    return read_submission(spark, f"{base}/out")


@register("stream_ewa", _hold_experts_sql().rstrip() + _LOSS_SQL + f"""
SELECT expert, round(cum_loss, 6) AS cum_loss, round(u / sum(u) OVER (), 6) AS weight FROM (
  SELECT expert, cum_loss, exp(-{ETA} * (cum_loss - min(cum_loss) OVER ())) AS u
  FROM (SELECT expert, sum(loss) AS cum_loss FROM losses GROUP BY expert))""", "2.13")
def stream_ewa_q(spark, sf):
    """EWA weights maintained by a foreachBatch stream over the labelled online
    arrivals; equals the batch EWA weights."""
    from ..streaming.online import stream_ewa
    train, hold = holdout_frames(spark, sf)
    st = TargetEncoder(TE_COLS, "label").fit(train)
    arrivals = hold.where("is_online").select("row_id", "label", *TE_COLS)
    w = stream_ewa(spark, arrivals, st, ETA)
    return w.select("expert", F.round("cum_loss", 6).alias("cum_loss"), F.round("weight", 6).alias("weight"))
