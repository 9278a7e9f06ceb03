"""Deterministic splits, folds, oversampling and class weights.

Randomness is a hash of the row id and a seed (md5), so results do not depend
on partitioning, task retries or executor loss (``randomSplit`` does).

Exact per-class ranks use a two-level scheme instead of one window per class
(which would put a whole class, possibly a third of the table, in one task):
rows are bucketed by the leading hex digits of their hash, bucket sizes are
counted (map-side combined), prefix offsets are a window over that small table,
and ``row_number`` runs only within (class, bucket).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_small

ROWS_PER_BUCKET = 200_000
ROWS_PER_TASK = 50_000     # fewer are not worth a task


def hash_key(row_id: Column | str, seed: int | str) -> Column:
    """32-hex md5 of ``<row_id>#<seed>`` (same text as ``hash_key_sql``)."""
    rid = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(rid.cast("string"), F.lit(f"#{seed}")))


def hash_key_sql(row_id: str, seed: int | str) -> str:
    return f"md5(CAST({row_id} AS VARCHAR) || '#{seed}')"


def hash_unit(key: Column) -> Column:
    """Uniform double in [0, 1) from the first 13 hex digits of a hash."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / float(16 ** 13)


def hash_unit_sql(key_sql: str) -> str:
    return f"(CAST(('0x' || substr({key_sql}, 1, 13)) AS BIGINT) / {float(16 ** 13)!r})"


def hash_int(key: Column) -> Column:
    """Non-negative bigint from the first 15 hex digits of a hash."""
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint")


def hash_int_sql(key_sql: str) -> str:
    return f"CAST(('0x' || substr({key_sql}, 1, 15)) AS BIGINT)"


def _digits_for(n: int) -> int:
    """Leading hash digits so that a bucket holds about ``ROWS_PER_BUCKET`` rows
    of a group even if the group is the whole table."""
    return 1 if n <= ROWS_PER_BUCKET else math.ceil(math.log(n / ROWS_PER_BUCKET, 16))


def exact_rank(df: DataFrame, part: Sequence[str], key: str, rank_col: str = "rank",
               n_rows: int | None = None, size_col: str | None = None) -> DataFrame:
    """1-based rank of ``key`` (distinct hex strings) within ``part`` groups.

    Equal to ``row_number() OVER (PARTITION BY part ORDER BY key)``.  With
    ``size_col`` the group size is added too (read off the offset table, no
    extra pass).  The offset table has one row per (group, bucket), about
    ``n_rows / ROWS_PER_BUCKET * 16`` at most; its join is left to the planner,
    which broadcasts it only below the session's size threshold.
    """
    part = list(part)
    d = _digits_for(df.count() if n_rows is None else n_rows)
    b = df.withColumn("_bkt", F.substring(F.col(key), 1, d))
    sizes = b.groupBy(*part, "_bkt").agg(F.count(F.lit(1)).alias("_bn"))
    group = Window.partitionBy(*part)
    before = group.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_bn").over(group).alias(size_col)] if size_col else []
    offsets = sizes.select(*part, "_bkt", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"), *extra)
    wr = Window.partitionBy(*part, "_bkt").orderBy(key)
    return b.join(offsets, [*part, "_bkt"], "inner") \
        .withColumn(rank_col, (F.col("_off") + F.row_number().over(wr)).cast("bigint")).drop("_bkt", "_off")


def in_tasks(df: DataFrame, n_rows: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df``, which is read many times, in tasks by its number of rows and the cluster's cores: a kept shuffle
    otherwise stays in the session's shuffle partitions, however few rows each holds.  Without a shuffle; never more than before."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-n_rows // rows_per_task)))


def stratified_split(df: DataFrame, label: str = "label", test_pct: int = 20, seed: int = 42,
                     row_id: str = "row_id", n_rows: int | None = None) -> DataFrame:
    """Adds ``is_val`` (boolean): within each class, the ``floor(n_c*pct/100)``
    rows with the smallest hash go to validation."""
    k = df.withColumn("_h", hash_key(row_id, seed))
    r = exact_rank(k, [label], "_h", "_r", n_rows, size_col="_n_c")
    return (r.withColumn("is_val", F.col("_r") * 100 <= F.col("_n_c") * test_pct)
             .drop("_h", "_r", "_n_c"))


def stratified_kfold(df: DataFrame, label: str = "label", k: int = 5, seed: int = 42,
                     row_id: str = "row_id", n_rows: int | None = None) -> DataFrame:
    """Adds ``fold`` in [0, k): class members dealt round-robin in hash order,
    so every fold holds each class's share to within one row."""
    h = df.withColumn("_h", hash_key(row_id, seed))
    r = exact_rank(h, [label], "_h", "_r", n_rows)
    return r.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_h", "_r")


def random_split(df: DataFrame, train_frac: float, seed: int = 13,
                 row_id: str = "row_id") -> DataFrame:
    """Adds ``is_train``: unstratified hash threshold (partition-independent)."""
    return df.withColumn("is_train", hash_unit(hash_key(row_id, seed)) < F.lit(train_frac))


def bround_half_even(x: float) -> int:
    return int(round(x))  # Python rounds half to even


@dataclass
class OversamplePlan:
    n0: int
    n2: int
    target: int

    @property
    def extra(self) -> int:
        return max(0, self.target - self.n2)


def oversample_plan(df: DataFrame, label: str, ratio: float, minority: int = 2,
                    reference: int = 0) -> OversamplePlan:
    counts = {r[label]: r["n"] for r in
              df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n2 = counts.get(reference, 0), counts.get(minority, 0)
    return OversamplePlan(n0, n2, max(n2, bround_half_even(ratio * n0)))


def oversample(df: DataFrame, label: str = "label", ratio: float = 0.1, seed: int = 42,
               minority: int = 2, reference: int = 0, row_id: str = "row_id") -> DataFrame:
    """Random oversampling with replacement of the minority class up to
    ``max(n2, round_half_even(ratio*n0))`` rows.  Original rows are kept
    (``draw`` null); each extra row is draw ``i`` of ``spark.range(extra)``,
    mapped to the minority row of rank ``hash(i) % n2 + 1``.
    """
    plan = oversample_plan(df, label, ratio, minority, reference)
    base = df.withColumn("draw", F.lit(None).cast("bigint"))
    if plan.extra == 0 or plan.n2 == 0:
        return base
    spark = df.sparkSession
    minor = df.where(F.col(label) == minority).withColumn("_h", hash_key(row_id, seed))
    ranked = exact_rank(minor, [label], "_h", "_r", plan.n2).drop("_h")
    n_parts = max(1, min(spark.sparkContext.defaultParallelism * 4, plan.extra // 100_000 + 1))
    draws = (spark.range(0, plan.extra, numPartitions=n_parts)
             .select(F.col("id").alias("draw"),
                     (hash_int(hash_key(F.col("id"), f"draw{seed}")) % plan.n2 + 1).alias("_r")))
    extra = ranked.join(draws, "_r").drop("_r")
    return base.unionByName(extra.select(*base.columns))


def balanced_weight(df: DataFrame, label: str = "label", out: str = "weight",
                    n_classes: int | None = None) -> DataFrame:
    """w = n / (k * n_c): one tiny class-count table joined by broadcast."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n_c"))
    w = Window.partitionBy()
    tab = counts.select(label, (F.sum("_n_c").over(w) /
                                ((F.lit(n_classes) if n_classes else F.count(F.lit(1)).over(w))
                                 * F.col("_n_c"))).alias(out))
    return join_small(df, tab, [label], how="left")


def alpha_weight(df: DataFrame, alpha: float, label: str = "label", weight: str = "weight",
                 cls: int = 2) -> DataFrame:
    base = F.col(weight) if weight in df.columns else F.lit(1.0)
    return df.withColumn(weight, F.when(F.col(label) == cls, base * alpha).otherwise(base))
