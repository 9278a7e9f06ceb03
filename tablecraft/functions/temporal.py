"""Arrival-date features: one projection, no job.

Builds the arrival date from year / month / day (impossible dates become
null) and derives day of week, weekend flag, ISO week, season and optional
cyclical encodings.  Original columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .months import month_lenient, season

DATE_COLS = ("arrival_date_year", "arrival_date_month", "arrival_date_day_of_month")


def _is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def arrival_date(df: DataFrame):
    year = F.col(DATE_COLS[0]).try_cast("double")
    month = month_lenient(DATE_COLS[1], numeric=_is_numeric(df, DATE_COLS[1]))
    day = F.col(DATE_COLS[2]).try_cast("double")
    ts = F.try_make_timestamp_ntz(year.cast("int"), month, day.cast("int"),
                                  F.lit(0), F.lit(0), F.lit(0))
    # a fractional year/day is not a date
    ok = (F.floor(year) == year) & (F.floor(day) == day)
    return F.when(ok, F.to_date(ts)), month


def temporal_features(df: DataFrame, cyclical: bool = False, use_season: bool = True) -> DataFrame:
    if not set(DATE_COLS).issubset(df.columns):
        return df
    d, month = arrival_date(df)
    dow = F.weekday(d)  # 0 = Monday .. 6 = Sunday
    cols = {
        "arrival_dow": dow.cast("int"),
        "arrival_is_weekend": F.coalesce((dow >= 5).cast("int"), F.lit(0)),
        "arrival_week": F.weekofyear(d).cast("int"),
    }
    if use_season:
        cols["arrival_season"] = season(month)
    if cyclical:
        m = F.coalesce(month, F.lit(0))
        dd = F.coalesce(dow, F.lit(0))
        two_pi = 2.0 * math.pi
        cols["arrival_month_sin"] = F.sin(two_pi * (m % 12) / 12.0)
        cols["arrival_month_cos"] = F.cos(two_pi * (m % 12) / 12.0)
        cols["arrival_dow_sin"] = F.sin(two_pi * (dd % 7) / 7.0)
        cols["arrival_dow_cos"] = F.cos(two_pi * (dd % 7) / 7.0)
    return df.withColumns(cols)
