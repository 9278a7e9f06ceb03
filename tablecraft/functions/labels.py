"""Target label mapping: text spellings to class ids 0/1/2.

Unknown text is an error (``raise_error``), evaluated lazily on executors, so
the check costs no extra pass: it fires when the first bad row is read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of the three classes (exact match).
LABEL_SPELLINGS = {
    "Check-out": 0, "Check-Out": 0, "check-out": 0, "Checkout": 0,
    "Cancel": 1, "cancel": 1,
    "No-Show": 2, "no-show": 2, "No Show": 2, "no show": 2,
}
CLASSES = (0, 1, 2)


def label_lookup(c: Column) -> Column:
    """Mapped class id or null (no error)."""
    m = F.create_map(*[x for k, v in LABEL_SPELLINGS.items() for x in (F.lit(k), F.lit(v))])
    return m[c]


def label_to_int(c: Column | str, numeric: bool = False) -> Column:
    """Class id for a label column; numeric labels pass through as int."""
    c = F.col(c) if isinstance(c, str) else c
    if numeric:
        return c.cast("int")
    mapped = label_lookup(c)
    err = F.raise_error(F.concat(F.lit("unrecognised target value: "),
                                 F.coalesce(c.cast("string"), F.lit("NULL"))))
    return F.when(mapped.isNotNull(), mapped).otherwise(err.cast("int")).cast("int")


def label_sql(col: str) -> str:
    """DuckDB/Spark SQL CASE for the same mapping (null when unknown)."""
    whens = " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in LABEL_SPELLINGS.items())
    return f"CAST(CASE {whens} END AS INTEGER)"
