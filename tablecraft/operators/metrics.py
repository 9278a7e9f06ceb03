"""Classification metrics as aggregations.

Weighted F1 is computed from the confusion counts ``groupBy(y, yhat)`` (at most
k*k rows after map-side combine), log-loss is a plain average.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import PROB_EPS


def confusion(df: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(
        F.count(F.lit(1)).alias("n"))


def per_class_f1(df: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    """(class, support, predicted, tp, f1); a class never predicted has f1 0."""
    return per_class_f1_grouped(df, y, yhat, [])


def per_class_f1_grouped(df: DataFrame, y: str, yhat: str, groups: list[str]) -> DataFrame:
    """per_class_f1 within each group (e.g. per fold).

    One scan: each confusion count adds to its true class's support and to its
    predicted class's row, so both sides come out of one small aggregate.
    """
    n, zero = F.col("n"), F.lit(0).cast("long")
    cm = df.groupBy(*groups, F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("y") == F.col("yhat"), n).otherwise(zero)
    sides = F.array(F.struct(F.col("y").alias("class"), n.alias("support"), zero.alias("predicted"), hit.alias("tp")),
                    F.struct(F.col("yhat").alias("class"), zero.alias("support"), n.alias("predicted"), zero.alias("tp")))
    t = cm.select(*groups, F.explode(sides).alias("s")).select(*groups, "s.*") \
        .groupBy(*groups, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])
    return t.withColumn("f1", F.when(F.col("tp") > 0, 2.0 * F.col("tp") /
                                     (F.col("support") + F.col("predicted"))).otherwise(0.0))


def f1_weighted_df(df: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    """One row: ``f1_weighted`` = sum_c support_c / N * F1_c."""
    t = per_class_f1(df, y, yhat)
    return t.agg((F.sum(F.col("support") * F.col("f1")) / F.sum("support")).alias("f1_weighted"))


def f1_weighted(df: DataFrame, y: str = "label", yhat: str = "prediction") -> float:
    return f1_weighted_df(df, y, yhat).first()[0]


def log_loss_df(df: DataFrame, p_true: str = "p_true") -> DataFrame:
    """One row: mean of -ln(clip(p_true))."""
    p = F.least(F.greatest(F.col(p_true), F.lit(PROB_EPS)), F.lit(1 - PROB_EPS))
    return df.agg(F.avg(-F.log(p)).alias("log_loss"))


def p_true_from_array(probs: str, label: str) -> F.Column:
    """Probability of the true class from an array<double> column (0-based)."""
    return F.element_at(F.col(probs), F.col(label) + 1)


def summary(scores: DataFrame, value: str = "v") -> DataFrame:
    """Mean and population std of per-fold scores."""
    return scores.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))

