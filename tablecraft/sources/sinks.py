"""Submission sink: ``(row_id, reservation_status int)`` keyed by id.

The id travels with every row through the whole plan, so the sink never
relies on row order.  Writes are distributed (one file per partition); the
target directory is overwritten atomically by the committer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def submission_frame(df: DataFrame, id_col: str = "row_id", pred_col: str = "prediction",
                     target_col: str = "reservation_status") -> DataFrame:
    return df.select(F.col(id_col), F.col(pred_col).cast("int").alias(target_col))


def write_submission(df: DataFrame, path: str, id_col: str = "row_id",
                     pred_col: str = "prediction", target_col: str = "reservation_status",
                     fmt: str = "csv") -> str:
    out = submission_frame(df, id_col, pred_col, target_col)
    w = out.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.format(fmt).save(path)
    return path


def read_submission(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    if fmt == "csv":
        return spark.read.schema("row_id bigint, reservation_status int").option("header", "true").csv(path)
    return spark.read.format(fmt).load(path)
