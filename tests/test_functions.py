"""Edge fixtures for scalar functions, temporal and domain features."""
import math

import pytest
from pyspark.sql import functions as F

from tablecraft.functions.domain import hotel_features
from tablecraft.functions.labels import LABEL_SPELLINGS, label_to_int
from tablecraft.functions.months import month_lenient, month_strict, season
from tablecraft.functions.scalar import argmax, clip, log1p_pos, prob_clip
from tablecraft.functions.temporal import temporal_features


def test_label_spellings(spark):
    rows = [(k,) for k in LABEL_SPELLINGS]
    df = spark.createDataFrame(rows, "raw string")
    got = {r.raw: r.y for r in df.select("raw", label_to_int("raw").alias("y")).collect()}
    assert got == LABEL_SPELLINGS
    num = spark.createDataFrame([(0,), (1,), (2,)], "raw int")
    assert [r.y for r in num.select(label_to_int("raw", numeric=True).alias("y")).collect()] == [0, 1, 2]


def test_label_unknown_raises(spark):
    df = spark.createDataFrame([("Checked",)], "raw string")
    with pytest.raises(Exception, match="unrecognised target"):
        df.select(label_to_int("raw")).collect()


def test_months_lenient(spark):
    cases = {"July": 7, "Jul": 7, "Juillet": 7, "août": 8, "aout": 8, " 7 ": 7, "13": None,
             "JULY": None, "juin": 6, None: None, "Février": 2, "May": 5}
    df = spark.createDataFrame([(k,) for k in cases], "m string")
    got = {r.m: r.k for r in df.select("m", month_lenient("m").alias("k")).collect()}
    assert got == cases


def test_month_strict_and_season(spark):
    df = spark.createDataFrame([("January",), ("December",), ("June",)], "m string")
    out = df.select(month_strict("m").alias("k")).withColumn("s", season(F.col("k"))).collect()
    assert [(r.k, r.s) for r in out] == [(1, 0), (12, 0), (6, 2)]
    bad = spark.createDataFrame([("Jan",)], "m string")
    with pytest.raises(Exception):
        bad.select(month_strict("m")).collect()


def test_temporal_edges(spark):
    rows = [(2024, "June", 1),     # Saturday
            (2024, "February", 30),  # impossible
            (2024, "March", None),  # null day
            (2024, "December", 30)]  # ISO week 1 of 2025
    df = spark.createDataFrame(rows, "arrival_date_year int, arrival_date_month string, arrival_date_day_of_month int")
    out = temporal_features(df, cyclical=True, use_season=True).collect()
    assert out[0].arrival_dow == 5 and out[0].arrival_is_weekend == 1
    assert out[1].arrival_dow is None and out[1].arrival_is_weekend == 0 and out[1].arrival_season == 0
    assert out[1].arrival_dow_sin == 0.0 and out[1].arrival_dow_cos == 1.0
    assert out[2].arrival_week is None and out[2].arrival_season == 1
    assert out[3].arrival_week == 1
    missing = df.drop("arrival_date_year")
    assert temporal_features(missing).columns == missing.columns


def test_hotel_edges(spark):
    schema = ("reserved_room_type string, assigned_room_type string, deposit_type string, "
              "adults double, children double, lead_time double, stays_in_weekend_nights double, "
              "stays_in_week_nights double, adr double")
    rows = [(None, None, None, 0.0, None, -5.0, 2.0, 5.0, 100.0),
            ("A", None, "No Deposit", 2.0, 1.0, None, 0.0, 1.0, None),
            ("A", "A", "Refundable", None, None, 10.0, None, None, 50.0)]
    out = hotel_features(spark.createDataFrame(rows, schema)).collect()
    assert [r.room_changed for r in out] == [0, 1, 0]
    assert [r.deposit_flag for r in out] == [1, 0, 1]
    assert [r.has_company for r in out] == [0, 0, 0]
    assert out[0].guests_total == 0.0 and out[0].adr_per_guest == 100.0 and out[0].long_stay == 1
    assert out[0].lead_time_log == 0.0 and out[1].lead_time_log is None
    assert out[1].adr_total == 0.0
    assert abs(out[0].prev_cancel_ratio) < 1e-12


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (5.0,)], "x double")
    out = df.select(clip("x", 0.0, 2.0).alias("c"), log1p_pos("x").alias("l"),
                    prob_clip(F.col("x") / 10).alias("p")).collect()
    assert [r.c for r in out] == [None, 0.0, 2.0]
    assert out[0].l is None and out[1].l == 0.0 and abs(out[2].l - math.log1p(5)) < 1e-12
    assert out[1].p == 1e-15
    arr = spark.createDataFrame([([0.2, 0.5, 0.5],)], "a array<double>")
    assert arr.select(argmax(F.col("a")).alias("k")).first().k == 1
