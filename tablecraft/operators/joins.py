"""Joins of a row table with a fitted state table.

All joins in this domain are equi left joins of the row table with a table
holding one row per category (encodings, counts, class weights).  The state
side is broadcast only when its row count, known from the fit, is under a
bound; otherwise it is a shuffle join and AQE's skew-join handling splits a
hot category on the row side.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Above this many state rows the state table is shuffled, not broadcast.
MAX_BROADCAST_ROWS = 2_000_000


def join_small(df: DataFrame, state: DataFrame, on: str | Sequence[str] | object,
               how: str = "left", state_rows: int | None = None,
               max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Left-join ``state`` onto ``df``; broadcast only with a proven size bound.

    ``state_rows`` is the state's row count when the caller already knows it
    (fits usually do); otherwise it is counted here (state tables are small
    aggregates, so the count is cheap).
    """
    if state_rows is None:
        state_rows = state.count()
    right = F.broadcast(state) if state_rows <= max_broadcast_rows else state
    return df.join(right, on, how)

