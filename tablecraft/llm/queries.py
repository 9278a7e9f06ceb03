"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("quality", "exact", "mixing", "tokens", "jaccard", "chat", "packing", "suffix", "sentences", "toxicity", "phrases", "imatch", "variants")

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in _MODULES:
    for _name, (_build, _sql) in import_module(f"{__package__}.{_m}").QUERIES.items():
        QUERIES[_name] = _build
        if _sql:
            ORACLE_SQL[_name] = _sql
