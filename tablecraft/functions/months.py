"""Month parsing and season code, as native Column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names and abbreviations (matched case-sensitively
# after trimming), French names (matched after lower-casing, accent-less forms
# included).
MONTHS_EN = ["January", "February", "March", "April", "May", "June", "July",
             "August", "September", "October", "November", "December"]
MONTHS_EN_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep",
                  "Oct", "Nov", "Dec"]
MONTHS_FR = {
    "janvier": 1, "février": 2, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5,
    "juin": 6, "juillet": 7, "août": 8, "aout": 8, "septembre": 9,
    "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12,
}


def _map(pairs) -> Column:
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.lit(v))])


def month_strict(c: Column | str) -> Column:
    """English full month name -> 1..12, anything else raises."""
    c = F.col(c) if isinstance(c, str) else c
    m = _map((name, i + 1) for i, name in enumerate(MONTHS_EN))[c]
    err = F.raise_error(F.concat(F.lit("bad month name: "), F.coalesce(c, F.lit("NULL"))))
    return F.when(m.isNotNull(), m).otherwise(err.cast("int")).cast("int")


def month_lenient(c: Column | str, numeric: bool = False) -> Column:
    """Lenient month parse; null when not recognised.

    Order: null -> null; numeric input -> int if in 1..12; trimmed English full
    name; English abbreviation; lower-cased French name; digit string 1..12.
    """
    c = F.col(c) if isinstance(c, str) else c
    if numeric:
        v = c.cast("int")
        return F.when((v >= 1) & (v <= 12), v).cast("int")
    t = F.trim(c)
    en = _map((name, i + 1) for i, name in enumerate(MONTHS_EN))[t]
    ab = _map((name, i + 1) for i, name in enumerate(MONTHS_EN_ABBR))[t]
    fr = _map(MONTHS_FR.items())[F.lower(t)]
    digits = F.when(t.rlike("^[0-9]+$"), t.try_cast("int"))
    num = F.when((digits >= 1) & (digits <= 12), digits)
    return F.coalesce(en, ab, fr, num).cast("int")


def season(month: Column) -> Column:
    """12,1,2 -> 0; 3-5 -> 1; 6-8 -> 2; 9-11 -> 3; null stays null."""
    return F.when(month.between(1, 12), F.floor((month % 12) / 3)).cast("int")


def month_lenient_sql(col: str) -> str:
    """DuckDB text equal to ``month_lenient`` on a string column."""
    t = f"trim({col})"
    en = " ".join(f"WHEN {t} = '{n}' THEN {i + 1}" for i, n in enumerate(MONTHS_EN))
    ab = " ".join(f"WHEN {t} = '{n}' THEN {i + 1}" for i, n in enumerate(MONTHS_EN_ABBR))
    fr = " ".join(f"WHEN lower({t}) = '{n}' THEN {v}" for n, v in MONTHS_FR.items())
    num = (f"WHEN regexp_full_match({t}, '[0-9]+') AND TRY_CAST({t} AS INTEGER) BETWEEN 1 AND 12 "
           f"THEN TRY_CAST({t} AS INTEGER)")
    return f"CAST(CASE {en} {ab} {fr} {num} END AS INTEGER)"
