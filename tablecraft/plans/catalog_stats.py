"""Queries for fit statistics (2.5) and learned transforms (2.6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from ..operators.transforms import (ImputeMedian, ImputeMode, OneHot, Scaler, SkewClipLog,
                                    TargetEncoder)
from ..sources.bookings import bookings, with_bookings
from ..sources.tables import read_table
from . import sqlgen
from .common import BOOKING_NUMERIC, BOOKING_STRING, LABELED_CTE, labeled, r6, reuse, split_sql, with_split
from .registry import register

NUM = BOOKING_NUMERIC
STR = BOOKING_STRING


def _long(spark: SparkSession, rows, schema: str) -> DataFrame:
    """Small fitted-state table (one row per column) as a DataFrame."""
    return spark.createDataFrame(rows, schema)


def _union_sql(cols, expr_fmt: str, src: str = "bookings") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {expr_fmt.format(c=f'CAST({c} AS DOUBLE)', s=c)} FROM {src}"
        for c in cols)


# --------------------------------------------------------------------------
# 2.5 aggregations
# --------------------------------------------------------------------------

@register("agg_quantile_bounds", with_bookings() + _union_sql(
    NUM, "round(quantile_cont({c}, 0.01), 6) AS q_lo, round(quantile_cont({c}, 0.99), 6) AS q_hi"), "2.5")
def agg_quantile_bounds(spark, sf):
    q = stats.exact_quantiles(bookings(spark, sf), NUM, [0.01, 0.99])
    return _long(spark, [(c, *[None if v is None else round(v, 6) for v in q[c]]) for c in NUM],
                 "column string, q_lo double, q_hi double")


@register("agg_median", with_bookings() + _union_sql(NUM, "round(quantile_cont({c}, 0.5), 6) AS median"), "2.5")
def agg_median(spark, sf):
    m = stats.medians(bookings(spark, sf), NUM)
    return _long(spark, [(c, None if m[c] is None else round(m[c], 6)) for c in NUM],
                 "column string, median double")


@register("agg_quantile_events", """SELECT
  (SELECT round(quantile_cont(value, 0.005), 6) FROM events) AS q005,
  (SELECT round(quantile_cont(value, 0.5), 6) FROM events) AS q50,
  (SELECT round(quantile_cont(value, 0.995), 6) FROM events) AS q995,
  (SELECT round(quantile_cont(CAST(n_chars AS DOUBLE), 0.02), 6) FROM documents) AS n_chars_q02""", "2.5")
def agg_quantile_events(spark, sf):
    """Exact quantiles on a skewed continuous column (events.value) and on
    documents.n_chars."""
    ev = stats.exact_quantiles(read_table(spark, sf, "events"), ["value"], [0.005, 0.5, 0.995])["value"]
    dq = stats.exact_quantiles(read_table(spark, sf, "documents"), ["n_chars"], [0.02])["n_chars"]
    return _long(spark, [tuple(round(v, 6) for v in ev + dq)],
                 "q005 double, q50 double, q995 double, n_chars_q02 double")


@register("agg_skewness", with_bookings() + _union_sql(NUM, "round(skewness({c}), 6) AS skew"), "2.5")
def agg_skewness(spark, sf):
    b = bookings(spark, sf)
    return b.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"))
                                        for c in NUM])).alias("e")) \
        .groupBy(F.col("e.column").alias("column")) \
        .agg(F.round(stats.corrected_skewness(F.col("e.x")), 6).alias("skew"))


@register("agg_min", with_bookings() + _union_sql(NUM, "min({c}) AS min"), "2.5")
def agg_min(spark, sf):
    b = bookings(spark, sf)
    r = b.agg(*[F.min(F.col(c).cast("double")).alias(c) for c in NUM]).first()
    return _long(spark, [(c, r[c]) for c in NUM], "column string, min double")


@register("agg_mean_std", with_bookings() + _union_sql(
    NUM, "round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std"), "2.5")
def agg_mean_std(spark, sf):
    ms = stats.mean_std(bookings(spark, sf), NUM)
    return _long(spark, [(c, round(m, 6), round(s, 6)) for c, (m, s) in ms.items()],
                 "column string, mean double, std double")


def _mode_sql(cols) -> str:
    u = sqlgen.unpivot_sql("bookings", cols)
    return with_bookings() + f"""SELECT "column", value AS mode FROM (
  SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC) AS rn
  FROM (SELECT "column", value, count(*) AS n FROM {u} WHERE value IS NOT NULL GROUP BY "column", value))
WHERE rn = 1"""


@register("agg_mode", _mode_sql(STR), "2.5")
def agg_mode(spark, sf):
    m = stats.modes(bookings(spark, sf), STR)
    return _long(spark, list(m.items()), "column string, mode string")


@register("agg_class_prior", with_bookings(LABELED_CTE) + """
SELECT label, count(*) AS n, count(*) / (SELECT count(*) FROM labeled) AS prior FROM labeled GROUP BY label""", "2.5")
def agg_class_prior(spark, sf):
    return stats.class_prior(labeled(spark, sf), "label")


@register("agg_class_counts", """SELECT quality AS label, count(*) AS n FROM labels GROUP BY quality""", "2.5")
def agg_class_counts(spark, sf):
    return stats.class_counts(read_table(spark, sf, "labels").withColumnRenamed("quality", "label"), "label")


@register("agg_cond_prob", with_bookings(LABELED_CTE) + """
, c AS (SELECT country, count(*) AS n, count_if(label = 0) AS n_0, count_if(label = 1) AS n_1,
               count_if(label = 2) AS n_2 FROM labeled WHERE country IS NOT NULL GROUP BY country)
SELECT country, 0 AS label, n_0 / n AS p FROM c UNION ALL
SELECT country, 1, n_1 / n FROM c UNION ALL SELECT country, 2, n_2 / n FROM c""".replace("\n, c AS", ", c AS", 1), "2.5")
def agg_cond_prob(spark, sf):
    """P(class | country); an absent (country, class) pair gives 0."""
    st = stats.category_class_stats(labeled(spark, sf), ["country"], "label", [0, 1, 2])
    return st.select(F.col("value").alias("country"), F.explode(F.array(*[
        F.struct(F.lit(j).alias("label"), (F.col(f"n_{j}") / F.col("n")).alias("p")) for j in (0, 1, 2)]))
        .alias("e")).select("country", "e.label", "e.p")


@register("agg_group_size", with_bookings() + """
SELECT country, count(*) AS n FROM bookings WHERE country IS NOT NULL GROUP BY country""", "2.5")
def agg_group_size(spark, sf):
    return (stats.category_counts(bookings(spark, sf), ["country"])
            .select(F.col("value").alias("country"), "n"))


@register("agg_count_distinct", with_bookings() + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS nunique, "
    f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_unique_with_null FROM bookings"
    for c in STR + ["agent", "children"]), "2.5")
def agg_count_distinct(spark, sf):
    cols = STR + ["agent", "children"]
    b = bookings(spark, sf)
    a = stats.count_distinct(b, cols)
    z = stats.count_distinct(b, cols, count_null=True)
    return _long(spark, [(c, a[c], z[c]) for c in cols],
                 "column string, nunique bigint, n_unique_with_null bigint")


@register("agg_category_freq", with_bookings() + f"""
SELECT "column", value, count(*) AS n FROM {sqlgen.unpivot_sql('bookings', STR)}
WHERE value IS NOT NULL GROUP BY "column", value""", "2.5")
def agg_category_freq(spark, sf):
    return stats.category_counts(bookings(spark, sf), STR)


# --------------------------------------------------------------------------
# 2.6 learned transforms
# --------------------------------------------------------------------------

def _skew_sql(p_lo: float, p_hi: float, thresh: float) -> str:
    stat = ", ".join(
        f"quantile_cont(CAST({c} AS DOUBLE), {p_lo / 100!r}) AS {c}__lo, "
        f"quantile_cont(CAST({c} AS DOUBLE), {p_hi / 100!r}) AS {c}__hi, "
        f"min(CAST({c} AS DOUBLE)) AS {c}__mn, skewness(CAST({c} AS DOUBLE)) AS {c}__sk"
        for c in NUM)
    outs = []
    for c in NUM:
        lo, hi, mn, sk = (f"(SELECT {c}__{x} FROM st)" for x in ("lo", "hi", "mn", "sk"))
        clipped = f"CASE WHEN {c} IS NOT NULL THEN least(greatest(CAST({c} AS DOUBLE), {lo}), {hi}) END"
        logd = f"CASE WHEN {clipped} IS NOT NULL THEN ln(1 + greatest({clipped}, 0.0)) END"
        body = (f"CASE WHEN {lo} < {hi} THEN (CASE WHEN {mn} >= 0 AND abs({sk}) > {thresh!r} "
                f"THEN {logd} ELSE {clipped} END) ELSE CAST({c} AS DOUBLE) END")
        outs.append(f"round({body}, 6) AS {c}")
    return with_bookings(f"st AS (SELECT {stat} FROM bookings)") + \
        f"SELECT row_id, {', '.join(outs)} FROM bookings"


def _skew_spark(spark, sf, p_lo, p_hi, thresh):
    b = bookings(spark, sf)
    st = SkewClipLog(p_lo, p_hi, thresh, columns=NUM).fit(b)
    out = st.apply(b)
    return out.select("row_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in NUM])


@register("tx_skew_clip_log", _skew_sql(1.0, 99.0, 1.0), "2.6")
def tx_skew_clip_log(spark, sf):
    return _skew_spark(spark, sf, 1.0, 99.0, 1.0)


@register("tx_skew_clip_log_2_98", _skew_sql(2.0, 98.0, 0.5), "2.6")
def tx_skew_clip_log_2_98(spark, sf):
    return _skew_spark(spark, sf, 2.0, 98.0, 0.5)


@register("tx_skew_clip_log_events", """
WITH st AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi,
                   min(value) AS mn, skewness(value) AS sk FROM events)
SELECT event_id, round(CASE WHEN (SELECT mn FROM st) >= 0 AND abs((SELECT sk FROM st)) > 1.0
  THEN ln(1 + greatest(least(greatest(value, (SELECT lo FROM st)), (SELECT hi FROM st)), 0.0))
  ELSE least(greatest(value, (SELECT lo FROM st)), (SELECT hi FROM st)) END, 6) AS value
FROM events""", "2.6")
def tx_skew_clip_log_events(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "value")
    st = SkewClipLog(columns=["value"]).fit(ev)
    return st.apply(ev).select("event_id", r6("value"))


_NULLY = ["children", "agent", "lead_time"]


@register("tx_impute_median", with_bookings(
    "med AS (SELECT " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}" for c in _NULLY) +
    " FROM bookings)") + "SELECT row_id, " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), (SELECT {c} FROM med)) AS {c}" for c in _NULLY) + " FROM bookings", "2.6")
def tx_impute_median(spark, sf):
    b = bookings(spark, sf)
    st = ImputeMedian(_NULLY).fit(b)
    return st.apply(b).select("row_id", *_NULLY)


_DIRTY_STR_SPARK = {
    "reserved_room_type": lambda: F.when(F.col("row_id") % 5 != 0, F.col("reserved_room_type")),
    "country": lambda: F.when(F.col("row_id") % 7 != 0, F.col("country")),
}
_DIRTY_STR_CTE = ("dirty AS (SELECT row_id, CASE WHEN row_id % 5 <> 0 THEN reserved_room_type END "
                  "AS reserved_room_type, CASE WHEN row_id % 7 <> 0 THEN country END AS country FROM bookings)")


def _mode_cte(name: str, src: str, cols) -> str:
    u = sqlgen.unpivot_sql(src, cols)
    return f"""{name} AS (SELECT "column", value AS mode FROM (
  SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value ASC) AS rn
  FROM (SELECT "column", value, count(*) AS n FROM {u} WHERE value IS NOT NULL GROUP BY "column", value))
  WHERE rn = 1)"""


@register("tx_impute_mode", with_bookings(_DIRTY_STR_CTE, _mode_cte("mo", "dirty", list(_DIRTY_STR_SPARK))) + """
SELECT row_id, coalesce(reserved_room_type, (SELECT mode FROM mo WHERE "column" = 'reserved_room_type'))
  AS reserved_room_type, coalesce(country, (SELECT mode FROM mo WHERE "column" = 'country')) AS country
FROM dirty""", "2.6")
def tx_impute_mode(spark, sf):
    b = bookings(spark, sf).select("row_id", *[f().alias(c) for c, f in _DIRTY_STR_SPARK.items()])
    st = ImputeMode(list(_DIRTY_STR_SPARK)).fit(b)
    return st.apply(b)


def _scale_sql(with_mean: bool) -> str:
    stat = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS {c}__mu, stddev_pop(CAST({c} AS DOUBLE)) AS {c}__sd"
                     for c in NUM)
    outs = []
    for c in NUM:
        mu = f"(SELECT {c}__mu FROM st)" if with_mean else "0.0"
        sd = f"(SELECT CASE WHEN {c}__sd IS NULL OR {c}__sd = 0 THEN 1.0 ELSE {c}__sd END FROM st)"
        outs.append(f"round((CAST({c} AS DOUBLE) - {mu}) / {sd}, 6) AS {c}")
    return with_bookings(f"st AS (SELECT {stat} FROM bookings)") + \
        f"SELECT row_id, {', '.join(outs)} FROM bookings"


def _scale_spark(spark, sf, with_mean):
    b = bookings(spark, sf)
    st = Scaler(with_mean=with_mean, columns=NUM).fit(b)
    return st.apply(b).select("row_id", *[r6(c) for c in NUM])


@register("tx_scale_nomean", _scale_sql(False), "2.6")
def tx_scale_nomean(spark, sf):
    return _scale_spark(spark, sf, False)


@register("tx_scale_standard", _scale_sql(True), "2.6")
def tx_scale_standard(spark, sf):
    return _scale_spark(spark, sf, True)


# one-hot family ----------------------------------------------------------

_OHE_COLS = ["market_segment", "deposit_type", "country", "reserved_room_type"]
_SPLIT_CTE = f"split AS (SELECT *, {split_sql()} AS is_train FROM bookings)"


def _ohe_sql(cols, min_freq, drop_bin, drop_first, src_cte=_SPLIT_CTE, train="(SELECT * FROM split WHERE is_train)",
             apply_src="split", key=("row_id",), use_bookings=True):
    ctes = [src_cte] + sqlgen.onehot_ctes(train, cols, min_freq, drop_bin, drop_first)
    head = with_bookings(*ctes) if use_bookings else "WITH " + ",\n".join(ctes) + "\n"
    return head + sqlgen.onehot_apply(apply_src, cols, key)


def _ohe_spark(df, cols, min_freq, drop_bin, drop_first, key=("row_id",)):
    train = df.where("is_train")
    st = OneHot(min_freq, drop_bin, drop_first, columns=cols).fit(train)
    return st.apply_long(df, list(key))


@register("tx_onehot", _ohe_sql(_OHE_COLS, None, False, False), "2.6")
def tx_onehot(spark, sf):
    return _ohe_spark(with_split(bookings(spark, sf)), _OHE_COLS, None, False, False)


@register("tx_onehot_minfreq", _ohe_sql(_OHE_COLS, 200, False, False), "2.6")
def tx_onehot_minfreq(spark, sf):
    """min_frequency=200: rare countries / room types pooled into one slot."""
    return _ohe_spark(with_split(bookings(spark, sf)), _OHE_COLS, 200, False, False)


_PART_CTE = f"split AS (SELECT *, {split_sql(row_id='p_partkey')} AS is_train FROM part)"


@register("tx_onehot_minfreq_part", _ohe_sql(["p_brand", "p_type"], 85, False, False, src_cte=_PART_CTE,
                                             key=("p_partkey",), use_bookings=False), "2.6")
def tx_onehot_minfreq_part(spark, sf):
    from ..operators.sampling import hash_key, hash_unit
    p = read_table(spark, sf, "part").withColumn(
        "is_train", hash_unit(hash_key("p_partkey", 7)) < F.lit(0.8))
    return _ohe_spark(p, ["p_brand", "p_type"], 85, False, False, key=("p_partkey",))


_LI_CTE = (f"split AS (SELECT *, {split_sql(row_id='l_orderkey')} AS is_train FROM lineitem)")


@register("tx_onehot_drop_binary", _ohe_sql(["l_linestatus", "l_returnflag"], None, True, False,
                                            src_cte=_LI_CTE, key=("l_orderkey", "l_linenumber"),
                                            use_bookings=False), "2.6")
def tx_onehot_drop_binary(spark, sf):
    from ..operators.sampling import hash_key, hash_unit
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag") \
        .withColumn("is_train", hash_unit(hash_key("l_orderkey", 7)) < F.lit(0.8))
    return _ohe_spark(li, ["l_linestatus", "l_returnflag"], None, True, False, key=("l_orderkey", "l_linenumber"))


@register("tx_dummies_drop_first", _ohe_sql(["deposit_type", "market_segment"], None, False, True), "2.6")
def tx_dummies_drop_first(spark, sf):
    """Dummy coding with a vocabulary fixed at fit (first sorted level dropped)."""
    return _ohe_spark(with_split(bookings(spark, sf)), ["deposit_type", "market_segment"], None, False, True)


# target encoding ------------------------------------------------------------

_TE_COLS = ["country", "market_segment", "reserved_room_type"]


def te_sql(cols=_TE_COLS) -> str:
    ctes = [LABELED_CTE, sqlgen.stratified_split_cte("sp", "labeled"),
            "tr AS (SELECT * FROM sp WHERE NOT is_val)", sqlgen.prior_cte("prior", "tr")]
    ctes += sqlgen.te_ctes("tr", cols, "prior")
    return with_bookings(*ctes) + sqlgen.te_apply("sp", cols, "prior")


def te_spark(spark, sf, cols=_TE_COLS):
    from ..operators.sampling import stratified_split
    sp = reuse(stratified_split(labeled(spark, sf), "label", 20, 42))
    st = TargetEncoder(cols, "label").fit(sp.where(~F.col("is_val")))
    out = st.apply(sp)
    return out.select("row_id", *[f"{c}_{j}" for c in cols for j in (0, 1, 2)])


@register("tx_target_encode", te_sql(), "2.6")
def tx_target_encode(spark, sf):
    """Smoothed (K=5) multi-class target encoding fitted on the stratified
    train part, applied to the train and the validation rows (unseen / null -> prior)."""
    return te_spark(spark, sf)


@register("join_encode_left", te_sql(["country"]), "2.7")
def join_encode_left(spark, sf):
    return te_spark(spark, sf, ["country"])
