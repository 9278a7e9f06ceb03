"""Typed table scans.

Parquet is the default source: column pruning and predicate pushdown reach
the scan because every caller selects its columns before acting.  CSV is
supported with a declared schema (``inferSchema`` only on request, since
inference is a full extra pass over the file).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value: null in every floating column."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             infer: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """Header CSV scan.  Give ``schema`` on production paths.

    A cell that does not fit its declared type is an error, never a silent null;
    ``mode="DROPMALFORMED"`` or ``"PERMISSIVE"`` are for callers who ask for it.
    Floating cells saying ``NaN`` are null.
    """
    reader = spark.read.option("header", "true").option("mode", mode)
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", "true")
    return nan_to_null(reader.csv(path))


# Declared schema of the booking table (columns the reference names); any
# other column is carried through by type.
BOOKING_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType(), False),
    T.StructField("reservation_status", T.StringType(), True),
    T.StructField("arrival_date_year", T.IntegerType(), True),
    T.StructField("arrival_date_month", T.StringType(), True),
    T.StructField("arrival_date_day_of_month", T.IntegerType(), True),
    T.StructField("stays_in_weekend_nights", T.LongType(), True),
    T.StructField("stays_in_week_nights", T.LongType(), True),
    T.StructField("adults", T.LongType(), True),
    T.StructField("children", T.DoubleType(), True),
    T.StructField("babies", T.DoubleType(), True),
    T.StructField("adr", T.DoubleType(), True),
    T.StructField("lead_time", T.DoubleType(), True),
    T.StructField("previous_cancellations", T.LongType(), True),
    T.StructField("previous_bookings_not_canceled", T.LongType(), True),
    T.StructField("reserved_room_type", T.StringType(), True),
    T.StructField("assigned_room_type", T.StringType(), True),
    T.StructField("agent", T.StringType(), True),
    T.StructField("company", T.StringType(), True),
    T.StructField("deposit_type", T.StringType(), True),
    T.StructField("country", T.StringType(), True),
])
