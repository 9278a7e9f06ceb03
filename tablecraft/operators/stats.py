"""Fit statistics: one aggregation job per stage, for all columns at once.

Everything here returns a *small* result: one value per column, or one row
per (column, category) kept as a DataFrame.  Nothing pulls rows to the driver.

Exact quantiles are computed without sorting a column in one task: an
approximate sketch (bounded memory, partial aggregation) brackets every target
rank, a second pass counts rows below each bracket, and a third pass histograms
only the rows inside the brackets.  Brackets with too many distinct values are
narrowed again inside themselves, so the collected histogram stays bounded
whatever the table size; a bracket of one value needs no histogram.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import join_small

RESERVED = ("row_id", "label", "weight", "fold", "reservation_status")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = RESERVED) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in ex]


def string_columns(df: DataFrame, exclude: Iterable[str] = RESERVED) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if not isinstance(f.dataType, T.NumericType) and f.name not in ex]


# --------------------------------------------------------------------------
# moments
# --------------------------------------------------------------------------

def corrected_skewness(c: Column) -> Column:
    """Bias-corrected sample skewness G1 (pandas ``skew``); 0 for constant
    columns, null for fewer than 3 values."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    sd = F.stddev_pop(c)
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(sd == 0, F.lit(0.0))
            .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)))


def column_profile(df: DataFrame, cols: Sequence[str]) -> dict[str, dict]:
    """count, min, max, mean, population std and G1 for every column, one job."""
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
                 F.avg(x).alias(f"mu{i}"), F.stddev_pop(x).alias(f"sd{i}"),
                 corrected_skewness(x).alias(f"sk{i}")]
    r = df.agg(*aggs).first()
    return {c: {"n": r[f"n{i}"], "min": r[f"mn{i}"], "max": r[f"mx{i}"], "mean": r[f"mu{i}"],
                "std": r[f"sd{i}"], "skew": r[f"sk{i}"]} for i, c in enumerate(cols)}


# --------------------------------------------------------------------------
# exact quantiles (linear interpolation, nulls skipped)
# --------------------------------------------------------------------------

def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    accuracy: int = 10_000, max_bracket_values: int = 100_000,
                    counts: dict[str, int] | None = None
                    ) -> dict[str, list[float | None]]:
    """Exact quantiles per column, equal to ``percentile`` / ``quantile_cont``.

    Returns ``{col: [q(p) for p in probs]}`` (None for an all-null column).
    ``counts`` (non-null values per column), when the caller already has
    them, saves the counting job.
    """
    between = quantile_neighbours(df, cols, probs, accuracy, max_bracket_values, counts)
    return {c: [interpolate(v) for v in vs] for c, vs in between.items()}


def interpolate(between: tuple[float, float, float] | None) -> float | None:
    """The quantile from its neighbours ``(value below, value above, share of the way)``."""
    if between is None:
        return None
    v0, v1, frac = between
    return v0 + frac * (v1 - v0) if frac else v0


def quantile_neighbours(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                        accuracy: int = 10_000, max_bracket_values: int = 100_000,
                        counts: dict[str, int] | None = None
                        ) -> dict[str, list[tuple[float, float, float] | None]]:
    """The two values that each quantile of ``exact_quantiles`` lies between, and how far it is from the first
    to the second.  A monotone function of a column has the function of these as its own."""
    if not cols:
        return {}
    xs = {c: F.col(c).cast("double") for c in cols}
    n = {c: counts[c] for c in cols} if counts is not None and all(c in counts for c in cols) else None
    # rows bound a bracket's values if they are few; else the distinct values do, which most columns have few of
    distinct = n
    if n is None or any(v > max_bracket_values for v in n.values()):
        counted, distinct = _counts_and_values(df, xs)
        n = n or counted

    # targets: (col, p) -> the 0-based ranks needed for interpolation
    targets = []
    for c in cols:
        for p in probs:
            if n[c] == 0:
                continue
            h = (n[c] - 1) * float(p)
            k0 = int(math.floor(h))
            k1 = min(k0 + 1, n[c] - 1)
            targets.append({"col": c, "p": p, "h": h, "k0": k0, "k1": k1,
                            "lo": None, "hi": None, "below": 0, "inside": n[c], "values": min(n[c], distinct[c])})

    eps = 1.0 / accuracy
    # every round leaves a bracket about 4 * eps of its rows, or fewer values than
    # the bound if ties hold them together
    while wide := [t for t in targets if t["values"] > max_bracket_values]:
        # sketch inside the current bracket; the target ranks are re-expressed
        # relative to the bracket; targets of one bracket share its sketch
        sketches: dict = {}
        for t in wide:
            m = t["inside"]
            q_lo = max(0.0, (t["k0"] - t["below"]) / m - 2 * eps)
            q_hi = min(1.0, (t["k1"] + 1 - t["below"]) / m + 2 * eps)
            sketches.setdefault((t["col"], t["lo"], t["hi"]), []).append((t, q_lo, q_hi))
        aggs = []
        for i, ((c, lo, hi), ts) in enumerate(sketches.items()):
            ranks = [q for _, *qs in ts for q in qs]
            aggs.append(F.percentile_approx(F.when(_in_bracket(xs[c], lo, hi), xs[c]), ranks, accuracy).alias(f"a{i}"))
        r = df.agg(*aggs).first()
        for i, ts in enumerate(sketches.values()):
            for k, (t, _, _) in enumerate(ts):
                t["lo"], t["hi"] = r[f"a{i}"][2 * k], r[f"a{i}"][2 * k + 1]
        _count_brackets(df, xs, wide)
        for t in wide:
            if not (t["below"] <= t["k0"] and t["below"] + t["inside"] > t["k1"]):
                # sketch bound violated: fall back to the full column range
                t["lo"], t["hi"], t["below"], t["inside"], t["values"] = None, None, 0, n[t["col"]], n[t["col"]]
                accuracy *= 4
                eps = 1.0 / accuracy

    hist = _bracket_histograms(df, xs, [t for t in targets if t["lo"] is None or t["lo"] != t["hi"]])
    out: dict[str, list] = {c: [] for c in cols}
    by_key = {(t["col"], t["p"]): t for t in targets}
    for c in cols:
        for p in probs:
            t = by_key.get((c, p))
            if t is None:
                out[c].append(None)
                continue
            frac = t["h"] - math.floor(t["h"])
            if id(t) not in hist:       # the bracket is one value
                out[c].append((t["lo"], t["lo"], 0.0))
                continue
            values = hist[id(t)]
            out[c].append((_value_at(values, t["k0"] - t["below"]), _value_at(values, t["k1"] - t["below"]), frac))
    return out


def _counts_and_values(df: DataFrame, xs: dict[str, Column]) -> tuple[dict[str, int], dict[str, int]]:
    """Non-null values of every column and, roughly, how many are distinct: one pass, one small plan."""
    entries = F.array(*[F.struct(F.lit(i).alias("k"), x.alias("v")) for i, x in enumerate(xs.values())])
    rows = (df.select(F.explode(entries).alias("e")).groupBy(F.col("e.k").alias("k"))
            .agg(F.count("e.v").alias("n"), F.approx_count_distinct("e.v").alias("d")).collect())
    got = {r["k"]: r for r in rows}
    return ({c: got[i]["n"] if i in got else 0 for i, c in enumerate(xs)},
            {c: got[i]["d"] if i in got else 0 for i, c in enumerate(xs)})


def _in_bracket(x: Column, lo, hi) -> Column:
    cond = x.isNotNull()
    if lo is not None:
        cond = cond & (x >= F.lit(lo))
    if hi is not None:
        cond = cond & (x <= F.lit(hi))
    return cond


def _count_brackets(df: DataFrame, xs, ts) -> None:
    aggs = []
    for i, t in enumerate(ts):
        x = xs[t["col"]]
        below = (x < F.lit(t["lo"])) if t["lo"] is not None else F.lit(False)
        aggs += [F.count_if(below).alias(f"b{i}"),
                 F.count_if(_in_bracket(x, t["lo"], t["hi"])).alias(f"i{i}"),
                 F.approx_count_distinct(F.when(_in_bracket(x, t["lo"], t["hi"]), x)).alias(f"d{i}")]
    r = df.agg(*aggs).first()
    for i, t in enumerate(ts):
        t["below"], t["inside"] = r[f"b{i}"], r[f"i{i}"]
        t["values"] = 1 if t["lo"] == t["hi"] else min(r[f"d{i}"], r[f"i{i}"])


def _bracket_histograms(df: DataFrame, xs, ts) -> dict[int, list[tuple[float, int]]]:
    """(value, count) sorted, for the rows inside each bracket (bounded)."""
    if not ts:
        return {}
    # targets that share a bracket share its histogram
    brackets: dict = {}
    for t in ts:
        brackets.setdefault((t["col"], t["lo"], t["hi"]), []).append(t)
    inside = [_in_bracket(xs[c], lo, hi) for c, lo, hi in brackets]
    entries = [F.when(cond, F.struct(F.lit(i).alias("k"), xs[c].alias("v"))) for i, (cond, (c, _, _)) in enumerate(zip(inside, brackets))]
    some = reduce(lambda a, b: a | b, inside)
    # most rows are in no bracket: they leave before any array is built
    rows = (df.where(some).select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"))
            .groupBy(F.col("e.k").alias("k"), F.col("e.v").alias("v")).count()
            .collect())
    found: list[list] = [[] for _ in brackets]
    for row in rows:
        found[row["k"]].append((row["v"], row["count"]))
    for h in found:
        h.sort()
    return {id(t): h for h, shared in zip(found, brackets.values()) for t in shared}


def _value_at(values: list[tuple[float, int]], k: int) -> float:
    acc = 0
    for v, cnt in values:
        acc += cnt
        if k < acc:
            return v
    raise ValueError("rank outside bracket")


def medians(df: DataFrame, cols: Sequence[str],
            counts: dict[str, int] | None = None) -> dict[str, float | None]:
    q = exact_quantiles(df, cols, [0.5], counts=counts)
    return {c: q[c][0] for c in cols}


# --------------------------------------------------------------------------
# categorical statistics (one shuffle for all columns)
# --------------------------------------------------------------------------

def unpivot_categories(df: DataFrame, cols: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """(column, value[, extra...]) rows, one per input row and column."""
    structs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
               for c in cols]
    return (df.select(*extra, F.explode(F.array(*structs)).alias("_cv"))
            .select(F.col("_cv.column").alias("column"), F.col("_cv.value").alias("value"), *extra))


def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n) for non-null values; map-side combined."""
    return (unpivot_categories(df, cols).where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column, smallest value on a tie."""
    if not cols:
        return {}
    # one pass: the least (-n, value) of a column, one row each
    best = category_counts(df, cols).groupBy("column").agg(F.min(F.struct(-F.col("n"), "value")).alias("best"))
    got = {r["column"]: r["best"]["value"] for r in best.collect()}
    return {c: got.get(c) for c in cols}


def count_distinct(df: DataFrame, cols: Sequence[str], count_null: bool = False) -> dict[str, int]:
    """Distinct values per column; ``count_null`` adds one when a null exists."""
    aggs = []
    for i, c in enumerate(cols):
        aggs.append(F.countDistinct(F.col(c)).alias(f"d{i}"))
        aggs.append(F.max(F.col(c).isNull().cast("int")).alias(f"z{i}"))
    r = df.agg(*aggs).first()
    return {c: r[f"d{i}"] + (r[f"z{i}"] or 0 if count_null else 0) for i, c in enumerate(cols)}


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_prior(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, prior) — P(class) on the given rows (3 rows)."""
    from pyspark.sql import Window
    c = class_counts(df, label)
    return c.withColumn("prior", F.col("n") / F.sum("n").over(Window.partitionBy()))


def category_class_stats(df: DataFrame, cols: Sequence[str], label: str,
                         classes: Sequence[int]) -> DataFrame:
    """(column, value, n, n_<j>...) per non-null category: one shuffle for all
    columns, with map-side partial counts (a hot category is pre-aggregated
    before the shuffle, so skew costs one row per map task)."""
    u = unpivot_categories(df, cols, extra=[label]).where(F.col("value").isNotNull())
    return u.groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(label) == j).alias(f"n_{j}") for j in classes])


def mean_std(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population std) per column, one job."""
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m{i}"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}")]
    r = df.agg(*aggs).first()
    return {c: (r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(cols)}


__all__ = [n for n in dir() if not n.startswith("_")] + ["join_small"]
