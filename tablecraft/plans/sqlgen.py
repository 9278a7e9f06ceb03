"""DuckDB text generators for the oracle side of the catalogue.

Each generator mirrors one Spark operator and keeps the same order of
floating-point operations, so exact arithmetic compares bit for bit.
"""

from __future__ import annotations

from typing import Sequence

from ..operators.sampling import hash_key_sql
from ..operators.transforms import INFREQUENT


def q(c: str) -> str:
    return f'"{c}"'


def unpivot_sql(src: str, cols: Sequence[str], extra: Sequence[str] = ()) -> str:
    ex = "".join(f"{e}, " for e in extra)
    parts = [f"SELECT {ex}'{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {src}" for c in cols]
    return "(" + " UNION ALL ".join(parts) + ")"


def stratified_split_cte(name: str, src: str, label: str = "label", pct: int = 20,
                         seed: int = 42) -> str:
    return f"""{name} AS (
  SELECT * EXCLUDE (_h, _r, _n), _r * 100 <= _n * {pct} AS is_val FROM (
    SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY _h) AS _r,
              count(*) OVER (PARTITION BY {label}) AS _n
    FROM (SELECT *, {hash_key_sql('row_id', seed)} AS _h FROM {src})))"""


def kfold_cte(name: str, src: str, label: str = "label", k: int = 5, seed: int = 42) -> str:
    return f"""{name} AS (
  SELECT * EXCLUDE (_h, _r), CAST((_r - 1) % {k} AS INTEGER) AS fold FROM (
    SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY _h) AS _r
    FROM (SELECT *, {hash_key_sql('row_id', seed)} AS _h FROM {src})))"""


def prior_cte(name: str, train: str, label: str = "label") -> str:
    return f"""{name} AS (
  SELECT {label} AS l, count(*) AS n, count(*) / (SELECT count(*) FROM {train}) AS p
  FROM {train} GROUP BY {label})"""


def prior_value(prior: str, j: int) -> str:
    return f"coalesce((SELECT p FROM {prior} WHERE l = {j}), 0.0)"


def te_ctes(train: str, cols: Sequence[str], prior: str, classes=(0, 1, 2), k: float = 5.0,
            label: str = "label", prefix: str = "enc") -> list[str]:
    """One encoding CTE per column: (v, e_<j>) with (n_j + K*P_j) / (n + K)."""
    out = []
    for c in cols:
        es = ", ".join(
            f"(count_if({label} = {j}) + {float(k)!r} * {prior_value(prior, j)}) / (count(*) + {float(k)!r}) AS e_{j}"
            for j in classes)
        out.append(f"{prefix}_{c} AS (SELECT CAST({c} AS VARCHAR) AS v, {es} FROM {train} "
                   f"WHERE {c} IS NOT NULL GROUP BY {c})")
    return out


def te_apply(src: str, cols: Sequence[str], prior: str, classes=(0, 1, 2), prefix: str = "enc",
             keep: Sequence[str] = ("row_id",)) -> str:
    """SELECT keep..., c_<j>... FROM src LEFT JOIN each encoding (unseen/null -> prior)."""
    sel = list(keep)
    joins = []
    for i, c in enumerate(cols):
        a = f"_t{i}"
        joins.append(f"LEFT JOIN {prefix}_{c} {a} ON CAST(s.{c} AS VARCHAR) = {a}.v")
        sel += [f"coalesce({a}.e_{j}, {prior_value(prior, j)}) AS {c}_{j}" for j in classes]
    sel = [x if ("(" in x or "." in x) else f"s.{x}" for x in sel]
    return f"SELECT {', '.join(sel)} FROM {src} s " + " ".join(joins)


def onehot_ctes(train: str, cols: Sequence[str], min_freq: int | None, drop_if_binary: bool,
                drop_first: bool, name: str = "ohe") -> list[str]:
    """codes table (column, value, slot) of the fitted one-hot vocabulary."""
    mf = min_freq or 0
    u = unpivot_sql(train, cols)
    return [
        f"{name}_cnt AS (SELECT \"column\", value, count(*) AS n, count(*) >= {mf} AS frequent "
        f"FROM {u} WHERE value IS NOT NULL GROUP BY \"column\", value)",
        f"""{name}_slots AS (
  SELECT "column", count_if(frequent) + max(CASE WHEN frequent THEN 0 ELSE 1 END) AS n_slots
  FROM {name}_cnt GROUP BY "column")""",
        f"""{name}_codes AS (
  SELECT c."column", c.value,
         CASE WHEN c.frequent THEN c.value ELSE '{INFREQUENT}' END AS slot,
         CASE WHEN c.frequent THEN (SELECT count(*) FROM {name}_cnt f
                                    WHERE f."column" = c."column" AND f.frequent AND f.value < c.value)
              ELSE (SELECT count_if(frequent) FROM {name}_cnt f WHERE f."column" = c."column") END AS code,
         {'TRUE' if drop_first else 'FALSE'} OR ({'TRUE' if drop_if_binary else 'FALSE'} AND s.n_slots = 2)
           AS first_dropped
  FROM {name}_cnt c JOIN {name}_slots s ON c."column" = s."column")""",
    ]


def onehot_apply(src: str, cols: Sequence[str], key: Sequence[str], name: str = "ohe") -> str:
    u = unpivot_sql(src, cols, extra=key)
    ks = ", ".join(f"u.{k}" for k in key)
    return (f"SELECT {ks}, u.\"column\", c.slot FROM {u} u JOIN {name}_codes c "
            f"ON u.\"column\" = c.\"column\" AND u.value = c.value "
            f"WHERE NOT (c.first_dropped AND c.code = 0)")
