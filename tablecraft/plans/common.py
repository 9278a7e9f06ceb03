"""Shared building blocks for the query catalogue (Spark side and SQL side)."""

from __future__ import annotations

from typing import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import label_sql, label_to_int
from ..functions.months import MONTHS_EN, month_strict
from ..operators.sampling import hash_key, hash_key_sql, hash_unit, hash_unit_sql
from ..sources.bookings import bookings

ND = 6  # decimals kept in compared float outputs (both engines)

# numeric / string columns of the bookings view, in schema order
BOOKING_NUMERIC = ["arrival_date_year", "arrival_date_day_of_month", "adr", "lead_time",
                   "stays_in_weekend_nights", "stays_in_week_nights", "adults", "children",
                   "previous_cancellations", "previous_bookings_not_canceled", "agent"]
BOOKING_STRING = ["arrival_date_month", "country", "market_segment", "deposit_type",
                  "reserved_room_type", "assigned_room_type"]


def r6(c, name: str | None = None):
    col = F.round(F.col(c) if isinstance(c, str) else c, ND)
    return col.alias(name or c) if (name or isinstance(c, str)) else col


def reuse(df: DataFrame) -> DataFrame:
    """Persist a frame that feeds several fit jobs (memory, spilling to disk).
    A lost executor recomputes its blocks from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookings with the integer ``label`` (0 check-out, 1 cancel, 2 no-show)."""
    b = bookings(spark, sf_dir)
    return b.withColumn("label", label_to_int("reservation_status")).drop("reservation_status")


LABELED_CTE = f"labeled AS (SELECT * EXCLUDE (reservation_status), {label_sql('reservation_status')} AS label FROM bookings)"


def with_split(df: DataFrame, seed: int = 7, frac: float = 0.8) -> DataFrame:
    """``is_train`` by hash threshold (deterministic, partition independent)."""
    return df.withColumn("is_train", hash_unit(hash_key("row_id", seed)) < F.lit(frac))


def split_sql(seed: int = 7, frac: float = 0.8, row_id: str = "row_id") -> str:
    return f"({hash_unit_sql(hash_key_sql(row_id, seed))} < {frac!r})"


SPLIT_CTE = f"split AS (SELECT *, {split_sql()} AS is_train FROM labeled)"


def month_number(c: str = "arrival_date_month"):
    return month_strict(c)


def month_number_sql(c: str = "arrival_date_month") -> str:
    whens = " ".join(f"WHEN {c} = '{m}' THEN {i + 1}" for i, m in enumerate(MONTHS_EN))
    return f"CAST(CASE {whens} ELSE error('bad month name') END AS INTEGER)"


def round_sql(expr: str, alias: str) -> str:
    return f"round({expr}, {ND}) AS {alias}"


def select_sql(cols: Sequence[str]) -> str:
    return ", ".join(cols)
