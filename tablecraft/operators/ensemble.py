"""Expert aggregation over a long probability table ``(row_id, expert, class, p)``.

* weighted average: ``sum_k w_k p_k(class)`` = one ``groupBy(row_id, class)``;
  the weight table (one row per expert) is broadcast.
* argmax per row: ``max(struct(p, -class))`` — first maximum wins.
* exponentially weighted average (EWA): ``w_k ∝ exp(-eta * L_k)`` with
  ``L_k`` the cumulative log-loss of expert ``k``; the final weights need only
  ``groupBy(expert).sum(loss)``.  The weight trajectory uses a running sum per
  expert computed by levels (time buckets, buckets of buckets, ..., then within
  a bucket) so no task holds a whole expert's history or its offsets.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import PROB_EPS
from ..session import cut_lineage
from .joins import join_small


def uniform_weights(long: DataFrame, expert: str = "expert") -> DataFrame:
    ex = long.select(expert).distinct()
    return ex.withColumn("w", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy()))


def weighted_average(long: DataFrame, weights: DataFrame, expert: str = "expert") -> DataFrame:
    """(row_id, class, p) with p = sum_k w_k * p_k / sum_k w_k."""
    w = join_small(long, weights, [expert], how="inner", state_rows=10_000)
    return w.groupBy("row_id", "class").agg(
        (F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("p"))


def argmax_long(probs: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, prediction): class of the largest p, smallest class on ties."""
    best = probs.groupBy(key).agg(F.max(F.struct(F.col("p"), (-F.col("class")).alias("nc"))).alias("b"))
    return best.select(key, (-F.col("b.nc")).cast("int").alias("prediction"))


def wide_probs(probs: DataFrame, classes: Sequence[int] = (0, 1, 2), key: str = "row_id",
               prefix: str = "p") -> DataFrame:
    """Pivot long probs to (key, p_0, p_1, ...) with explicit pivot values."""
    return (probs.groupBy(key).pivot("class", list(classes)).agg(F.first("p"))
            .withColumnsRenamed({str(j): f"{prefix}_{j}" for j in classes}))


def expert_losses(long: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """(row_id, expert, loss) with loss = -ln(clip(p of the true class))."""
    j = long.join(labels.select("row_id", label), "row_id")
    pt = j.where(F.col("class") == F.col(label))
    p = F.least(F.greatest(F.col("p"), F.lit(PROB_EPS)), F.lit(1 - PROB_EPS))
    return pt.select("row_id", "expert", (-F.log(p)).alias("loss"))


def ewa_weights(losses: DataFrame, eta: float = 0.5) -> DataFrame:
    """(expert, cum_loss, weight): final EWA weights from cumulative losses,
    stabilised by subtracting the smallest cumulative loss."""
    s = losses.groupBy("expert").agg(F.sum("loss").alias("cum_loss"))
    w = Window.partitionBy()
    e = s.withColumn("_u", F.exp(-eta * (F.col("cum_loss") - F.min("cum_loss").over(w))))
    return e.select("expert", "cum_loss", (F.col("_u") / F.sum("_u").over(w)).alias("weight"))


OFFSETS = 100_000          # bucket totals of one part that a single window may run over


def running_sum(df: DataFrame, part: Sequence[str], order: str, value: str, out: str,
                bucket_width: int, offsets: int = OFFSETS, inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` ordered by the integer ``order`` within ``part``: totals per bucket, their exclusive
    prefix, and a running sum within (part, bucket).  While a part has more than ``offsets`` buckets the prefix is
    itself found this way, one level up, so no task holds a part's offsets."""
    part = list(part)
    start = F.col(order) - F.pmod(F.col(order), F.lit(bucket_width))
    b = df.withColumn("_b", start)
    tot = cut_lineage(b.groupBy(*part, "_b").agg(F.sum(value).alias("_bt")))
    n = tot.groupBy(*part).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (n[0] or 0) <= offsets:
        wo = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        offs = tot.withColumn("_off", F.coalesce(F.sum("_bt").over(wo), F.lit(0.0)))
    else:
        up = tot.withColumnRenamed("_b", "_at")
        offs = running_sum(up, part, "_at", "_bt", "_before", bucket_width * offsets, offsets, inclusive=False) \
            .withColumnsRenamed({"_at": "_b", "_before": "_off"})
    j = join_small(b, offs.select(*part, "_b", "_off"), [*part, "_b"], how="inner", state_rows=n[1] or 0)
    last = Window.currentRow if inclusive else -1
    wi = Window.partitionBy(*part, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, last)
    return j.withColumn(out, F.col("_off") + F.coalesce(F.sum(value).over(wi), F.lit(0.0))).drop("_b", "_off")


def ewa_trajectory(losses: DataFrame, order: str = "t", eta: float = 0.5,
                   bucket_width: int = 4096) -> DataFrame:
    """(t, expert, weight): weights *after* observing step t (sequential EWA
    with uniform start, equal to the multiplicative recursion)."""
    cum = running_sum(losses, ["expert"], order, "loss", "cum_loss", bucket_width)
    w = Window.partitionBy(order)
    e = cum.withColumn("_u", F.exp(-eta * (F.col("cum_loss") - F.min("cum_loss").over(w))))
    return e.select(order, "row_id", "expert", (F.col("_u") / F.sum("_u").over(w)).alias("weight"))
