"""Registered queries (``queries()``) and their SQL oracles (``oracle_sql()``)."""

from __future__ import annotations

from privtab.plans import kanon, models, prep, reports, scoring

_MODULES = [kanon, prep, reports, scoring, models]


def queries():
    out = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql():
    out = {}
    for m in _MODULES:
        out.update(m.ORACLES)
    return out
