"""SQL-expressible experts: class prior and smoothed target encodings.

Each expert gives every row a class-probability vector (they sum to 1).  They
feed the ensembling operators exactly like fitted models do, and they make
stacking / weighted averaging / EWA checkable against DuckDB.
"""

from __future__ import annotations

from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import stats
from ..operators.joins import join_small
from ..operators.transforms import TargetEncoder
from . import sqlgen

CLASSES = (0, 1, 2)
K = 5.0


def expert_long(train: DataFrame, apply_df: DataFrame, cols: Sequence[str],
                label: str = "label") -> DataFrame:
    """(row_id, expert, class, p) for the prior expert and one target-encoding
    expert per column, fitted on ``train`` (one aggregation) and applied to
    ``apply_df`` (broadcast joins)."""
    st = TargetEncoder(list(cols), label, CLASSES, K).fit(train)
    enc = st.apply(apply_df.select("row_id", *cols))
    entries = [F.struct(F.lit("prior").alias("expert"), F.lit(j).alias("class"),
                        F.lit(st.prior[j]).alias("p")) for j in CLASSES]
    entries += [F.struct(F.lit(f"te_{c}").alias("expert"), F.lit(j).alias("class"),
                         F.col(f"{c}_{j}").alias("p")) for c in cols for j in CLASSES]
    return enc.select("row_id", F.explode(F.array(*entries)).alias("e")) \
        .select("row_id", "e.expert", "e.class", "e.p")


def expert_long_sql(train: str, apply_src: str, cols: Sequence[str], name: str = "experts",
                    prior: str = "prior") -> list[str]:
    """CTEs ending in ``<name>`` (row_id, expert, class, p)."""
    ctes = [sqlgen.prior_cte(prior, train)]
    ctes += sqlgen.te_ctes(train, cols, prior, prefix=f"enc_{name}")
    ctes.append(f"{name}_wide AS ({sqlgen.te_apply(apply_src, cols, prior, prefix=f'enc_{name}')})")
    parts = [f"SELECT row_id, 'prior' AS expert, {j} AS class, {sqlgen.prior_value(prior, j)} AS p FROM {name}_wide"
             for j in CLASSES]
    parts += [f"SELECT row_id, 'te_{c}', {j}, {c}_{j} FROM {name}_wide" for c in cols for j in CLASSES]
    ctes.append(f"{name} AS ({' UNION ALL '.join(parts)})")
    return ctes


def oof_target_encode(df: DataFrame, cols: Sequence[str], label: str = "label", fold: str = "fold",
                      k: float = K) -> DataFrame:
    """Out-of-fold encodings for every row in ONE aggregation.

    Counts per (fold, column, value, class) are computed once; the encoding a
    row of fold f receives uses the counts of all other folds, i.e. the total
    minus fold f's own counts (and the prior likewise).  Equal to fitting the
    encoder k times on the k training parts.
    """
    cls = list(CLASSES)
    u = stats.unpivot_categories(df, cols, extra=[fold, label]).where(F.col("value").isNotNull())
    per = u.groupBy(fold, "column", "value").agg(
        F.count(F.lit(1)).alias("nf"), *[F.count_if(F.col(label) == j).alias(f"nf_{j}") for j in cls])
    wcv = Window.partitionBy("column", "value")  # at most k rows per window
    per = per.select(fold, "column", "value",
                     (F.sum("nf").over(wcv) - F.col("nf")).alias("n"),
                     *[(F.sum(f"nf_{j}").over(wcv) - F.col(f"nf_{j}")).alias(f"n_{j}") for j in cls])
    # class counts per fold -> prior of the complement (k x classes rows)
    cc = df.groupBy(fold).agg(F.count(F.lit(1)).alias("cf"),
                              *[F.count_if(F.col(label) == j).alias(f"cf_{j}") for j in cls])
    wall = Window.partitionBy()
    pri = cc.select(fold, *[((F.sum(f"cf_{j}").over(wall) - F.col(f"cf_{j}")) /
                             (F.sum("cf").over(wall) - F.col("cf"))).alias(f"pr_{j}") for j in cls])
    enc = join_small(per, pri, [fold], how="inner", state_rows=1000).select(
        fold, "column", "value", "n",
        *[F.when(F.col("n") > 0, (F.col(f"n_{j}") + F.lit(k) * F.col(f"pr_{j}")) / (F.col("n") + F.lit(k)))
          .alias(f"e_{j}") for j in cls])
    enc = enc.persist(StorageLevel.MEMORY_AND_DISK)
    # (fold, category) rows per column: one small job decides broadcast vs shuffle
    sizes = {r["column"]: r["count"] for r in enc.groupBy("column").count().collect()}
    out = join_small(df.select("row_id", fold, *cols), pri, [fold], how="inner", state_rows=1000)
    for c in cols:
        t = enc.where(F.col("column") == c).select(
            F.col(fold).alias("_f"), F.col("value").alias("_v"), *[F.col(f"e_{j}").alias(f"_e_{j}") for j in cls])
        out = join_small(out, t, (F.col(fold) == F.col("_f")) & (F.col(c).cast("string") == F.col("_v")),
                         how="left", state_rows=sizes.get(c, 0))
        out = out.withColumns({f"{c}_{j}": F.coalesce(F.col(f"_e_{j}"), F.col(f"pr_{j}")) for j in cls}) \
            .drop("_f", "_v", *[f"_e_{j}" for j in cls])
    return out.select("row_id", fold, *[f"{c}_{j}" for c in cols for j in cls])


def oof_sql(src: str, cols: Sequence[str], k_folds: int = 5) -> list[str]:
    """CTEs ending in ``oof`` (row_id, fold, c_j...) — one fit per fold."""
    ctes = []
    parts = []
    for f in range(k_folds):
        tr, pr = f"tr{f}", f"prior{f}"
        ctes.append(f"{tr} AS (SELECT * FROM {src} WHERE fold <> {f})")
        ctes.append(sqlgen.prior_cte(pr, tr))
        ctes += sqlgen.te_ctes(tr, cols, pr, prefix=f"enc{f}")
        parts.append(sqlgen.te_apply(f"(SELECT * FROM {src} WHERE fold = {f})", cols, pr,
                                     prefix=f"enc{f}", keep=("row_id", "fold")))
    ctes.append("oof AS (" + " UNION ALL ".join(parts) + ")")
    return ctes
