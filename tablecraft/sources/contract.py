"""Input contract checks as one aggregation over the table.

The reference raises on a missing target / id column or an unmapped label.
Here the column checks are schema checks (no job) and the value checks are a
single ``agg``: null ids, duplicate ids, null labels, unmapped labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import label_lookup


class ContractError(ValueError):
    pass


def require_columns(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ContractError(f"missing required column(s): {missing}")


def contract_counts(df: DataFrame, id_col: str = "row_id",
                    target_col: str | None = "reservation_status") -> DataFrame:
    require_columns(df, id_col, *([target_col] if target_col else []))
    aggs = [F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col(id_col).isNull()).alias("null_ids"),
            (F.count(F.lit(1)) - F.countDistinct(id_col)).alias("dup_ids")]
    if target_col:
        t = F.col(target_col)
        aggs += [F.count_if(t.isNull()).alias("null_labels"),
                 F.count_if(t.isNotNull() & label_lookup(t).isNull()).alias("unmapped_labels")]
    return df.agg(*aggs)


def check_contract(df: DataFrame, id_col: str = "row_id",
                   target_col: str | None = "reservation_status") -> dict:
    r = contract_counts(df, id_col, target_col).first().asDict()
    bad = {k: v for k, v in r.items() if k != "n_rows" and v}
    if bad:
        raise ContractError(f"input contract violated: {bad}")
    return r
