"""Queries for sources, projections, scalar functions, temporal and domain features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.domain import hotel_features
from ..functions.labels import label_lookup, label_sql
from ..functions.months import month_lenient, month_lenient_sql, season
from ..functions.scalar import argmax, clip, log1p_pos, prob_clip, to_numeric
from ..functions.temporal import temporal_features
from ..sources.bookings import bookings, with_bookings
from .common import (BOOKING_STRING, LABELED_CTE, labeled, month_number, month_number_sql, r6)
from .registry import register

# --------------------------------------------------------------------------
# 2.1 sources and contract
# --------------------------------------------------------------------------


@register("src_scan_bookings", with_bookings() + "SELECT * FROM bookings", "2.1")
def src_scan_bookings(spark, sf):
    return bookings(spark, sf)


@register("src_contract", with_bookings() + f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count_if(row_id IS NULL) AS BIGINT) AS null_ids,
       CAST(count(*) - count(DISTINCT row_id) AS BIGINT) AS dup_ids,
       CAST(count_if(reservation_status IS NULL) AS BIGINT) AS null_labels,
       CAST(count_if(reservation_status IS NOT NULL AND {label_sql('reservation_status')} IS NULL) AS BIGINT)
         AS unmapped_labels
FROM bookings""", "2.1")
def src_contract(spark, sf):
    from ..sources.contract import contract_counts
    return contract_counts(bookings(spark, sf), "row_id", "reservation_status")


BOOKINGS_DDL = ("row_id bigint, reservation_status string, arrival_date_year int, arrival_date_month string, "
                "arrival_date_day_of_month int, country string, market_segment string, deposit_type string, "
                "adr double, lead_time double, stays_in_weekend_nights bigint, stays_in_week_nights bigint, "
                "adults bigint, children bigint, previous_cancellations bigint, "
                "previous_bookings_not_canceled bigint, reserved_room_type string, assigned_room_type string, "
                "agent bigint")


@register("src_csv_scan", with_bookings() + "SELECT * FROM bookings", "2.1")
def src_csv_scan(spark, sf):
    """Header CSV written (distributed) to the shared folder and scanned back
    with a declared schema (no inference pass)."""
    import uuid
    from ..session import ensure_checkpoint_dir
    from ..sources.tables import read_csv
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    bookings(spark, sf).write.mode("overwrite").option("header", "true").csv(path)
    return read_csv(spark, path, schema=BOOKINGS_DDL)


@register("sink_submission", with_bookings(LABELED_CTE) + """
SELECT row_id, CAST(label AS INTEGER) AS reservation_status FROM labeled""", "2.1")
def sink_submission(spark, sf):
    """Writes a (row_id, reservation_status) submission and reads it back."""
    from ..sources.sinks import read_submission, write_submission
    from ..session import ensure_checkpoint_dir
    import uuid
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/submission-{uuid.uuid4().hex}"
    df = labeled(spark, sf).withColumnRenamed("label", "prediction")
    write_submission(df, out, fmt="parquet")
    return read_submission(spark, out, fmt="parquet")


# --------------------------------------------------------------------------
# 2.2 projections and scalar functions
# --------------------------------------------------------------------------

@register("proj_label_map", with_bookings() + f"""
SELECT row_id, {label_sql('reservation_status')} AS label FROM bookings""", "2.2")
def proj_label_map(spark, sf):
    return labeled(spark, sf).select("row_id", "label")


@register("proj_label_spellings", with_bookings() + f"""
, sp AS (SELECT row_id, (['Check-out','Check-Out','check-out','Checkout','Cancel','cancel',
                         'No-Show','no-show','No Show','no show','Checked'])[CAST(row_id % 11 AS INTEGER) + 1] AS raw
         FROM bookings)
SELECT row_id, raw, {label_sql('raw')} AS label FROM sp""".replace("\n, sp", ", sp", 1), "2.2")
def proj_label_spellings(spark, sf):
    """Every accepted spelling plus one unknown ('Checked' -> null, no error)."""
    spell = F.array(*[F.lit(s) for s in ["Check-out", "Check-Out", "check-out", "Checkout", "Cancel",
                                         "cancel", "No-Show", "no-show", "No Show", "no show",
                                         "Checked"]])
    b = bookings(spark, sf).select("row_id", F.element_at(spell, (F.col("row_id") % 11 + 1).cast("int"))
                                   .alias("raw"))
    return b.select("row_id", "raw", label_lookup(F.col("raw")).cast("int").alias("label"))


@register("proj_drop_cols", with_bookings() + """
SELECT * EXCLUDE (row_id, reservation_status) FROM bookings""", "2.2")
def proj_drop_cols(spark, sf):
    b = bookings(spark, sf)
    return b.drop(*[c for c in ("row_id", "reservation_status", "not_a_column") if c in b.columns])


@register("proj_card_router", with_bookings() + """
, u AS (
  SELECT 'arrival_date_month' AS "column", arrival_date_month AS value FROM bookings UNION ALL
  SELECT 'country', country FROM bookings UNION ALL
  SELECT 'market_segment', market_segment FROM bookings UNION ALL
  SELECT 'deposit_type', deposit_type FROM bookings UNION ALL
  SELECT 'reserved_room_type', reserved_room_type FROM bookings UNION ALL
  SELECT 'assigned_room_type', assigned_room_type FROM bookings)
SELECT "column", CAST(count(DISTINCT value) + max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unique,
       CASE WHEN count(DISTINCT value) + max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) >= 3
            THEN 'target_encode' ELSE 'one_hot' END AS route
FROM u GROUP BY "column"
""".replace("\n, u AS", ", u AS", 1), "2.2")
def proj_card_router(spark, sf):
    from ..operators.encoding import cardinality_router
    return cardinality_router(bookings(spark, sf), BOOKING_STRING)


@register("proj_to_numeric", with_bookings() + """
SELECT row_id, TRY_CAST(CAST(agent AS VARCHAR) AS DOUBLE) AS agent_num,
       TRY_CAST(country AS DOUBLE) AS country_num,
       TRY_CAST(CAST(arrival_date_day_of_month AS VARCHAR) || 'x' AS DOUBLE) AS bad_num
FROM bookings""", "2.2")
def proj_to_numeric(spark, sf):
    b = bookings(spark, sf)
    return b.select("row_id", to_numeric(F.col("agent").cast("string")).alias("agent_num"),
                    to_numeric(F.col("country")).alias("country_num"),
                    to_numeric(F.concat(F.col("arrival_date_day_of_month").cast("string"), F.lit("x")))
                    .alias("bad_num"))


@register("proj_cast_float", with_bookings() + """
SELECT row_id, CAST(adults AS DOUBLE) AS adults, CAST(children AS DOUBLE) AS children,
       CAST(lead_time AS DOUBLE) AS lead_time, CAST(country AS VARCHAR) AS country
FROM bookings""", "2.2")
def proj_cast_float(spark, sf):
    b = bookings(spark, sf)
    return b.select("row_id", *[F.col(c).cast("double").alias(c) for c in ("adults", "children", "lead_time")],
                    F.col("country").cast("string").alias("country"))


@register("proj_cast_category", with_bookings() + """
SELECT row_id, CAST(dense_rank() OVER (ORDER BY country) - 1 AS INTEGER) AS country_ix,
       CAST(dense_rank() OVER (ORDER BY market_segment) - 1 AS INTEGER) AS market_segment_ix
FROM bookings""", "2.2")
def proj_cast_category(spark, sf):
    """Categorical dtype for native-categorical learners: alphabetical index
    (StringIndexer metadata), fitted by one distinct-values job."""
    from pyspark.ml.feature import StringIndexer
    b = bookings(spark, sf)
    cols = ["country", "market_segment"]
    ix = StringIndexer(inputCols=cols, outputCols=[f"{c}_ix" for c in cols],
                       stringOrderType="alphabetAsc", handleInvalid="keep").fit(b)
    return ix.transform(b).select("row_id", *[F.col(f"{c}_ix").cast("int").alias(f"{c}_ix") for c in cols])


@register("fn_month_strict", with_bookings() + f"""
SELECT row_id, {month_number_sql()} AS month FROM bookings""", "2.2")
def fn_month_strict(spark, sf):
    return bookings(spark, sf).select("row_id", month_number().alias("month"))


FR = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre",
      "octobre", "novembre", "décembre"]


def _dirty_month_spark(b):
    m = month_number()
    fr = F.element_at(F.array(*[F.lit(x) for x in FR]), m)
    k = (F.col("row_id") % 8).cast("int")
    raw = (F.when(k == 0, F.col("arrival_date_month"))
           .when(k == 1, F.substring("arrival_date_month", 1, 3))
           .when(k == 2, F.upper("arrival_date_month"))
           .when(k == 3, F.concat(F.lit(" "), m.cast("string"), F.lit(" ")))
           .when(k == 4, fr)
           .when(k == 5, F.concat(F.upper(F.substring(fr, 1, 1)), F.substring(fr, 2, 100)))
           .when(k == 6, F.lit("13")))
    return b.select("row_id", "arrival_date_year", raw.alias("arrival_date_month"),
                    (F.col("arrival_date_day_of_month") + (F.col("row_id") % 3) * 10).cast("int")
                    .alias("arrival_date_day_of_month"))


def _dirty_month_sql_cte() -> str:
    m = month_number_sql()
    fr = "[" + ", ".join(f"'{x}'" for x in FR) + f"][{m}]"
    return f"""dirty AS (
  SELECT row_id, arrival_date_year,
    CASE CAST(row_id % 8 AS INTEGER)
      WHEN 0 THEN arrival_date_month
      WHEN 1 THEN substr(arrival_date_month, 1, 3)
      WHEN 2 THEN upper(arrival_date_month)
      WHEN 3 THEN ' ' || CAST({m} AS VARCHAR) || ' '
      WHEN 4 THEN {fr}
      WHEN 5 THEN upper(substr({fr}, 1, 1)) || substr({fr}, 2, 100)
      WHEN 6 THEN '13' END AS arrival_date_month,
    CAST(arrival_date_day_of_month + (row_id % 3) * 10 AS INTEGER) AS arrival_date_day_of_month
  FROM bookings)"""


@register("fn_month_lenient", with_bookings(_dirty_month_sql_cte()) + f"""
SELECT row_id, arrival_date_month AS raw, {month_lenient_sql('arrival_date_month')} AS month FROM dirty""", "2.2")
def fn_month_lenient(spark, sf):
    d = _dirty_month_spark(bookings(spark, sf))
    return d.select("row_id", F.col("arrival_date_month").alias("raw"),
                    month_lenient("arrival_date_month").alias("month"))


@register("fn_season", with_bookings() + f"""
SELECT row_id, CAST(floor(({month_number_sql()} % 12) / 3) AS INTEGER) AS season FROM bookings""", "2.2")
def fn_season(spark, sf):
    return bookings(spark, sf).select("row_id", season(month_number()).alias("season"))


@register("fn_clip", with_bookings() + """
SELECT row_id, CASE WHEN children IS NOT NULL THEN least(greatest(CAST(children AS DOUBLE), 0.5), 2.0) END AS children_c,
       CASE WHEN adr IS NOT NULL THEN least(greatest(adr, 50.0), 300.0) END AS adr_c,
       CASE WHEN lead_time IS NOT NULL THEN greatest(lead_time, 10.0) END AS lead_lo
FROM bookings""", "2.2")
def fn_clip(spark, sf):
    b = bookings(spark, sf)
    return b.select("row_id", clip(F.col("children").cast("double"), 0.5, 2.0).alias("children_c"),
                    clip("adr", 50.0, 300.0).alias("adr_c"), clip("lead_time", 10.0).alias("lead_lo"))


@register("fn_log1p", with_bookings() + """
SELECT row_id, CASE WHEN lead_time IS NOT NULL THEN round(ln(1 + greatest(lead_time - 25.0, 0.0)), 6) END AS lead_log,
       CASE WHEN children IS NOT NULL THEN round(ln(1 + greatest(CAST(children AS DOUBLE) - 1, 0.0)), 6) END AS children_log
FROM bookings""", "2.2")
def fn_log1p(spark, sf):
    b = bookings(spark, sf)
    return b.select("row_id", r6(log1p_pos(F.col("lead_time") - 25.0), "lead_log"),
                    r6(log1p_pos(F.col("children").cast("double") - 1), "children_log"))


@register("fn_prob_clip", with_bookings() + """
SELECT row_id, CASE WHEN p IS NOT NULL THEN round(-ln(least(greatest(p, 1e-15), 1 - 1e-15)), 6) END AS nll
FROM (SELECT row_id, CAST(stays_in_weekend_nights AS DOUBLE) /
             nullif(stays_in_weekend_nights + stays_in_week_nights, 0) AS p FROM bookings)""", "2.2")
def fn_prob_clip(spark, sf):
    b = bookings(spark, sf)
    p = F.col("stays_in_weekend_nights") / F.nullif(
        F.col("stays_in_weekend_nights") + F.col("stays_in_week_nights"), F.lit(0))
    return b.select("row_id", r6(-F.log(prob_clip(p)), "nll"))


@register("fn_argmax", with_bookings() + """
SELECT row_id, CASE WHEN list_max(a) IS NOT NULL THEN CAST(list_position(a, list_max(a)) - 1 AS INTEGER) END AS k
FROM (SELECT row_id, [stays_in_weekend_nights, stays_in_week_nights, previous_bookings_not_canceled] AS a FROM bookings)""", "2.2")
def fn_argmax(spark, sf):
    b = bookings(spark, sf)
    arr = F.array("stays_in_weekend_nights", "stays_in_week_nights", "previous_bookings_not_canceled")
    return b.select("row_id", argmax(arr).alias("k"))


@register("flt_class", with_bookings(LABELED_CTE) + """
SELECT row_id, country, adr FROM labeled WHERE label = 2""", "2.2")
def flt_class(spark, sf):
    return labeled(spark, sf).where(F.col("label") == 2).select("row_id", "country", "adr")


# --------------------------------------------------------------------------
# 2.3 temporal features
# --------------------------------------------------------------------------

def _temporal_sql(src: str, cyclical: bool, use_season: bool) -> str:
    m = month_lenient_sql("arrival_date_month")
    d = ("CASE WHEN floor(CAST(arrival_date_year AS DOUBLE)) = CAST(arrival_date_year AS DOUBLE) "
         "AND floor(CAST(arrival_date_day_of_month AS DOUBLE)) = CAST(arrival_date_day_of_month AS DOUBLE) "
         f"THEN try(make_date(CAST(arrival_date_year AS BIGINT), {m}, "
         "CAST(arrival_date_day_of_month AS BIGINT))) END")
    cols = [f"CAST(isodow(_d) - 1 AS INTEGER) AS arrival_dow",
            "CAST(coalesce(isodow(_d) - 1 >= 5, false) AS INTEGER) AS arrival_is_weekend",
            "CAST(weekofyear(_d) AS INTEGER) AS arrival_week"]
    if use_season:
        cols.append("CASE WHEN _m BETWEEN 1 AND 12 THEN CAST(floor((_m % 12) / 3) AS INTEGER) END AS arrival_season")
    if cyclical:
        two_pi = repr(2 * math.pi)
        cols += [f"round(sin({two_pi} * (coalesce(_m, 0) % 12) / 12.0), 6) AS arrival_month_sin",
                 f"round(cos({two_pi} * (coalesce(_m, 0) % 12) / 12.0), 6) AS arrival_month_cos",
                 f"round(sin({two_pi} * (coalesce(isodow(_d) - 1, 0) % 7) / 7.0), 6) AS arrival_dow_sin",
                 f"round(cos({two_pi} * (coalesce(isodow(_d) - 1, 0) % 7) / 7.0), 6) AS arrival_dow_cos"]
    return (f"SELECT row_id, arrival_date_year, arrival_date_month, arrival_date_day_of_month, "
            f"{', '.join(cols)} FROM (SELECT *, {d} AS _d, {m} AS _m FROM {src})")


def _temporal_spark(df, cyclical, use_season):
    out = temporal_features(df, cyclical=cyclical, use_season=use_season)
    keep = ["row_id", "arrival_date_year", "arrival_date_month", "arrival_date_day_of_month",
            "arrival_dow", "arrival_is_weekend", "arrival_week"]
    if use_season:
        keep.append("arrival_season")
    cyc = ["arrival_month_sin", "arrival_month_cos", "arrival_dow_sin", "arrival_dow_cos"] if cyclical else []
    return out.select(*keep, *[r6(c) for c in cyc])


@register("time_features", with_bookings() + _temporal_sql("bookings", True, True), "2.3")
def time_features(spark, sf):
    return _temporal_spark(bookings(spark, sf), True, True)


@register("time_assemble_dirty", with_bookings(_dirty_month_sql_cte()) + _temporal_sql("dirty", True, True), "2.3")
def time_assemble_dirty(spark, sf):
    """Lenient months, impossible days (up to 51) -> null date, weekend 0, cyclical 0."""
    return _temporal_spark(_dirty_month_spark(bookings(spark, sf)), True, True)


@register("time_no_season", with_bookings() + _temporal_sql("bookings", False, False), "2.3")
def time_no_season(spark, sf):
    return _temporal_spark(bookings(spark, sf), False, False)


# --------------------------------------------------------------------------
# 2.4 domain features
# --------------------------------------------------------------------------

HOTEL_COLS = ["nights_total", "guests_total", "weekend_stay", "long_stay", "room_changed",
              "has_agent", "has_company", "deposit_flag"]


def _hotel_sql(src: str, total: bool, ratio: bool, has_adr: bool = True, has_lead: bool = True) -> str:
    nights = "(coalesce(CAST(stays_in_weekend_nights AS DOUBLE), 0) + coalesce(CAST(stays_in_week_nights AS DOUBLE), 0))"
    guests = "(coalesce(CAST(adults AS DOUBLE), 0) + coalesce(CAST(children AS DOUBLE), 0) + 0.0)"
    adr = "coalesce(adr, 0.0)" if has_adr else "0.0"
    # exact IEEE arithmetic (one rounding per operation, same order in both
    # engines) is compared unrounded; only ln() is rounded
    cols = [f"{nights} AS nights_total", f"{guests} AS guests_total",
            "CAST(coalesce(CAST(stays_in_weekend_nights AS DOUBLE), 0) > 0 AS INTEGER) AS weekend_stay",
            f"CAST({nights} >= 7 AS INTEGER) AS long_stay",
            "CAST(reserved_room_type IS DISTINCT FROM assigned_room_type AS INTEGER) AS room_changed",
            "CAST(agent IS NOT NULL AS INTEGER) AS has_agent",
            "0 AS has_company",
            "CAST(deposit_type IS DISTINCT FROM 'No Deposit' AS INTEGER) AS deposit_flag"]
    if total:
        cols += [f"{adr} * {nights} AS adr_total",
                 f"{adr} / greatest({guests}, 1.0) AS adr_per_guest"]
    if ratio:
        pc, pnc = "coalesce(CAST(previous_cancellations AS DOUBLE), 0)", "coalesce(CAST(previous_bookings_not_canceled AS DOUBLE), 0)"
        cols.append(f"{pc} / ({pc} + {pnc} + 1e-6) AS prev_cancel_ratio")
    if has_lead:
        cols.append("CASE WHEN lead_time IS NOT NULL THEN round(ln(1 + greatest(lead_time, 0.0)), 6) END AS lead_time_log")
    return f"SELECT row_id, {', '.join(cols)} FROM {src}"


def _hotel_spark(df, total, ratio):
    out = hotel_features(df, use_total_cost=total, use_prev_ratio=ratio)
    exact = (["adr_total", "adr_per_guest"] if total else []) + (["prev_cancel_ratio"] if ratio else [])
    logs = ["lead_time_log"] if "lead_time" in df.columns else []
    ints = ["weekend_stay", "long_stay", "room_changed", "has_agent", "has_company", "deposit_flag"]
    return out.select("row_id", "nights_total", "guests_total", *ints, *exact, *[r6(c) for c in logs])


@register("feat_hotel", with_bookings() + _hotel_sql("bookings", True, True), "2.4")
def feat_hotel(spark, sf):
    return _hotel_spark(bookings(spark, sf), True, True)


@register("feat_hotel_base", with_bookings() + _hotel_sql("bookings", False, False), "2.4")
def feat_hotel_base(spark, sf):
    return _hotel_spark(bookings(spark, sf), False, False)


@register("feat_hotel_missing_cols", with_bookings() +
          _hotel_sql("(SELECT * EXCLUDE (adr, lead_time) FROM bookings)", True, True,
                     has_adr=False, has_lead=False), "2.4")
def feat_hotel_missing_cols(spark, sf):
    """adr and lead_time absent: amounts default to 0, no lead_time_log."""
    return _hotel_spark(bookings(spark, sf).drop("adr", "lead_time"), True, True)
