"""Learned transforms: ``fit`` = one aggregation job, ``apply`` = lazy plan.

Fitted scalars (bounds, medians, means) are inlined as literals in a single
``select``; fitted per-category tables stay DataFrames and are joined with
``join_small`` (broadcast below a proven size, shuffle above).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip, col_, log1p_pos
from . import stats
from .joins import join_small

INFREQUENT = "__infrequent__"


def _replace(df: DataFrame, exprs: dict[str, Column], drop: Sequence[str] = ()) -> DataFrame:
    """One projection replacing columns in place (keeps column order)."""
    out = [exprs[c].alias(c) if c in exprs else F.col(c) for c in df.columns if c not in drop]
    return df.select(*out)


def _kept(table: DataFrame) -> DataFrame:
    """A state table that many jobs read, kept in at most as many tasks as the cluster runs at once."""
    return table.coalesce(table.sparkSession.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)


# --------------------------------------------------------------------------
# quantile clipping + selective log
# --------------------------------------------------------------------------

@dataclass(frozen=True)
class ColumnRule:
    """What happens to one column: clipped to [lo, hi], then log1p if ``log``."""
    lo: float
    hi: float
    log: bool

    def of(self, c: str | Column) -> Column:
        value = clip(col_(c).cast("double"), self.lo, self.hi)
        return log1p_pos(value) if self.log else value


@dataclass
class SkewClipLogState:
    rules: dict[str, ColumnRule]
    counts: dict[str, int] | None = None      # non-null values: clip and log keep nulls

    @property
    def bounds(self) -> dict[str, tuple[float, float]]:
        return {c: (r.lo, r.hi) for c, r in self.rules.items()}

    @property
    def log_cols(self) -> list[str]:
        return [c for c, r in self.rules.items() if r.log]

    def apply(self, df: DataFrame) -> DataFrame:
        return _replace(df, {c: rule.of(c) for c, rule in self.rules.items() if c in df.columns})


@dataclass
class SkewClipLog:
    """Bounds are exact quantiles; columns without a range stay as they are.  A column that is nowhere negative and
    skewed beyond the threshold, both as measured before clipping, gets the logarithm."""
    p_low: float = 1.0
    p_high: float = 99.0
    skew_thresh: float = 1.0
    columns: Sequence[str] | None = None

    def __post_init__(self):
        if not (0 <= self.p_low < self.p_high <= 100):
            raise ValueError("need 0 <= p_low < p_high <= 100")

    def fit(self, df: DataFrame) -> SkewClipLogState:
        cols = stats.numeric_columns(df) if self.columns is None else list(self.columns)
        seen = stats.column_profile(df, cols)
        counts = {c: seen[c]["n"] for c in cols}
        return self.from_stats(seen, stats.exact_quantiles(df, cols, self.probs, counts=counts))

    @property
    def probs(self) -> list[float]:
        return [self.p_low / 100.0, self.p_high / 100.0]

    def from_stats(self, seen: dict[str, dict], ranges: dict[str, list]) -> SkewClipLogState:
        """The state from known profiles and quantiles (at ``probs``) of the columns of ``ranges``."""
        def skewed(c: str) -> bool:
            g = seen[c]["skew"]
            return g is not None and abs(g) > self.skew_thresh and seen[c]["min"] >= 0.0    # NaN is not above
        return SkewClipLogState({c: ColumnRule(*r, skewed(c)) for c, r in ranges.items() if None not in r and r[0] < r[1]},
                                {c: seen[c]["n"] for c in ranges})


# --------------------------------------------------------------------------
# imputation and scaling
# --------------------------------------------------------------------------

@dataclass
class ImputeState:
    fill: dict[str, object]
    dropped: list[str]

    as_double: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        if self.as_double:  # numeric imputation outputs floats
            exprs = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(v)))
                     for c, v in self.fill.items() if c in df.columns}
        else:
            exprs = {c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
                     for c, v in self.fill.items() if c in df.columns}
        return _replace(df, exprs, drop=[c for c in self.dropped if c in df.columns])


@dataclass
class ImputeMedian:
    columns: Sequence[str] | None = None
    counts: dict[str, int] | None = None   # known non-null counts (skip a job)

    def fit(self, df: DataFrame) -> ImputeState:
        cols = list(self.columns) if self.columns is not None else stats.numeric_columns(df)
        med = stats.medians(df, cols, counts=self.counts)
        fill = {c: float(v) for c, v in med.items() if v is not None}
        # a column with no observed value is dropped, as the reference's imputer does
        return ImputeState(fill, [c for c, v in med.items() if v is None], as_double=True)


@dataclass
class ImputeMode:
    columns: Sequence[str] | None = None

    def fit(self, df: DataFrame) -> ImputeState:
        cols = list(self.columns) if self.columns is not None else stats.string_columns(df)
        m = stats.modes(df, cols)
        return ImputeState({c: v for c, v in m.items() if v is not None},
                           [c for c, v in m.items() if v is None])


@dataclass
class ScaleState:
    params: dict[str, tuple[float, float]]  # col -> (shift, scale)

    def apply(self, df: DataFrame) -> DataFrame:
        exprs = {c: (F.col(c).cast("double") - F.lit(mu)) / F.lit(sd)
                 for c, (mu, sd) in self.params.items() if c in df.columns}
        return _replace(df, exprs)


@dataclass
class Scaler:
    """x / sigma_pop (``with_mean=False``) or (x - mu) / sigma_pop.
    A zero or undefined sigma scales by 1."""
    with_mean: bool = False
    columns: Sequence[str] | None = None

    def fit(self, df: DataFrame) -> ScaleState:
        cols = list(self.columns) if self.columns is not None else stats.numeric_columns(df)
        return self.from_stats(stats.mean_std(df, cols))

    def from_stats(self, ms: dict[str, tuple[float, float]]) -> ScaleState:
        params = {}
        for c, (mu, sd) in ms.items():
            sd = 1.0 if sd is None or sd == 0 or math.isnan(sd) else sd
            params[c] = ((mu or 0.0) if self.with_mean else 0.0, sd)
        return ScaleState(params)


# --------------------------------------------------------------------------
# one-hot family (min_frequency pooling, drop if binary, drop first)
# --------------------------------------------------------------------------

@dataclass
class OneHotState:
    """``codes``: (column, value, code, category) per seen category.
    ``categories``: output category names per column, in output order."""
    codes: DataFrame
    categories: dict[str, list[str]]
    n_codes: int
    counted: DataFrame | None = None

    def release(self) -> None:
        """Drops the cached tables of the fit."""
        self.codes.unpersist()
        if self.counted is not None:
            self.counted.unpersist()

    def width(self, c: str) -> int:
        return len(self.categories[c])

    def apply_codes(self, df: DataFrame, suffix: str = "__code") -> DataFrame:
        """Adds ``<c>__code`` (0-based output slot, null = all zeros) per column."""
        out = df
        for c in self.categories:
            tab = (self.codes.where(F.col("column") == c)
                   .select(F.col("value").alias(f"_k_{c}"), F.col("code").alias(f"{c}{suffix}")))
            out = join_small(out, tab, F.col(c).cast("string") == F.col(f"_k_{c}"),
                             state_rows=self.n_codes).drop(f"_k_{c}")
        return out

    def apply_long(self, df: DataFrame, key: Sequence[str]) -> DataFrame:
        """(key..., column, slot) for every non-zero indicator: one unpivot and
        one join for all columns (an unseen or null value yields no row)."""
        u = stats.unpivot_categories(df, list(self.categories), extra=list(key))
        return join_small(u, self.codes.select("column", "value", "slot"), ["column", "value"],
                          how="inner", state_rows=self.n_codes * max(1, len(self.categories))) \
            .select(*key, "column", "slot")

    def apply(self, df: DataFrame, keep: bool = False) -> DataFrame:
        """Wide 0/1 indicator columns ``<c>_<category>``; input column dropped."""
        coded = self.apply_codes(df)
        exprs = []
        for c, cats in self.categories.items():
            code = F.col(f"{c}__code")
            exprs += [F.coalesce((code == i).cast("int"), F.lit(0)).alias(f"{c}_{cat}")
                      for i, cat in enumerate(cats)]
        drop = {f"{c}__code" for c in self.categories} | (set() if keep else set(self.categories))
        return coded.select(*[x for x in coded.columns if x not in drop], *exprs)


@dataclass
class OneHot:
    """Sorted categories; ``min_frequency`` pools rarer seen categories into
    one infrequent slot (placed last); unseen and null -> all zeros.
    ``drop_if_binary`` keeps one indicator for two-slot columns; ``drop_first``
    drops the first slot always (dummy coding)."""
    min_frequency: int | None = None
    drop_if_binary: bool = False
    drop_first: bool = False
    columns: Sequence[str] | None = None

    def fit(self, df: DataFrame) -> OneHotState:
        cols = list(self.columns) if self.columns is not None else stats.string_columns(df)
        counts = stats.category_counts(df, cols)
        mf = self.min_frequency or 0
        # counted once for the summary and the code table
        flagged = _kept(counts.withColumn("frequent", F.col("n") >= F.lit(mf)))
        # driver needs only the frequent vocabulary (bounded by rows/min_frequency)
        # and whether each column has an infrequent slot
        summary = (flagged.groupBy("column")
                   .agg(F.sort_array(F.collect_list(F.when(F.col("frequent"), F.col("value"))))
                        .alias("vocab"),
                        F.max((~F.col("frequent")).cast("int")).alias("has_rare"),
                        F.count(F.lit(1)).alias("n_values"))
                   .collect())
        cats: dict[str, list[str]] = {c: [] for c in cols}
        n_codes = 0
        for r in summary:
            cats[r["column"]] = list(r["vocab"]) + ([INFREQUENT] if r["has_rare"] else [])
            n_codes = max(n_codes, r["n_values"])
        first_dropped = {c: (self.drop_first or (self.drop_if_binary and len(v) == 2)) and len(v) > 0
                         for c, v in cats.items()}
        # code table built from the same rule on the executors
        rows = []
        for c, v in cats.items():
            shift = 1 if first_dropped[c] else 0
            for i, cat in enumerate(v):
                if cat != INFREQUENT:
                    rows.append((c, cat, i - shift))
        spark = df.sparkSession
        vocab_df = spark.createDataFrame(rows, "column string, value string, code int") \
            if rows else spark.createDataFrame([], "column string, value string, code int")
        infreq_code = {c: len(v) - 1 - (1 if first_dropped[c] else 0) for c, v in cats.items()}
        codes = (flagged.join(vocab_df, ["column", "value"], "left")
                 .select("column", "value", "frequent",
                         F.when(F.col("frequent"), F.col("code"))
                          .otherwise(F.element_at(F.create_map(*[x for c, k in infreq_code.items()
                                                                 for x in (F.lit(c), F.lit(k))]),
                                                  F.col("column"))).alias("code")))
        codes = (codes.where(F.col("code") >= 0)
                 .withColumn("slot", F.when(F.col("frequent"), F.col("value"))
                             .otherwise(F.lit(INFREQUENT))))
        # materialised once: every apply joins it instead of re-aggregating
        codes = _kept(codes)
        out_cats = {c: (v[1:] if first_dropped[c] else v) for c, v in cats.items()}
        return OneHotState(codes, out_cats, n_codes, flagged)


# --------------------------------------------------------------------------
# smoothed multi-class target encoding
# --------------------------------------------------------------------------

@dataclass
class TargetEncodeState:
    table: DataFrame            # (column, value, n, e_<j>...)
    prior: dict[int, float]
    classes: list[int]
    columns: list[str]
    n_rows: int | None = None   # largest per-column category count, if known

    def apply(self, df: DataFrame, keep: bool = False) -> DataFrame:
        """Replaces each column ``c`` by ``c_<j>``; unseen / null -> prior."""
        out = df
        for c in self.columns:
            tab = (self.table.where(F.col("column") == c)
                   .select(F.col("value").alias(f"_k_{c}"),
                           *[F.col(f"e_{j}").alias(f"_{c}_{j}") for j in self.classes]))
            out = join_small(out, tab, F.col(c).cast("string") == F.col(f"_k_{c}"),
                             state_rows=self.n_rows)
        # one projection for all columns: each more costs an analysis of the whole plan
        enc = {f"{c}_{j}": F.coalesce(F.col(f"_{c}_{j}"), F.lit(self.prior[j])) for c in self.columns for j in self.classes}
        kept = [c for c in df.columns if keep or c not in self.columns]
        return out.select(*[enc[c].alias(c) if c in enc else F.col(c) for c in kept],
                          *[e.alias(c) for c, e in enc.items() if c not in kept])


@dataclass
class TargetEncoder:
    columns: Sequence[str]
    label: str = "label"
    classes: Sequence[int] = (0, 1, 2)
    smoothing: float = 5.0

    def fit(self, df: DataFrame) -> TargetEncodeState:
        cls = list(self.classes)
        pr = {r[self.label]: r["n"] for r in stats.class_counts(df, self.label).collect()}
        total = sum(pr.values())
        prior = {j: pr.get(j, 0) / total for j in cls}
        k = float(self.smoothing)
        st = stats.category_class_stats(df, self.columns, self.label, cls)
        table = st.select("column", "value", "n", *[
            ((F.col(f"n_{j}") + F.lit(k * prior[j])) / (F.col("n") + F.lit(k))).alias(f"e_{j}")
            for j in cls])
        # materialise the (small) state once: one job, and its size decides
        # broadcast vs shuffle for every later apply
        table = _kept(table)
        sizes = table.groupBy("column").count().collect()
        n_max = max([r["count"] for r in sizes], default=0)
        return TargetEncodeState(table, prior, cls, list(self.columns), n_rows=n_max)
