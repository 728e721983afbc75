"""The query catalogue: one entry per operator, with the SQL it is held against."""

from __future__ import annotations

from . import blocks, corpus, derived, evaluation, files, mixes, scoring, sinks, stores, tokens

MODULES = (corpus, blocks, derived, mixes, scoring, stores, evaluation, files, sinks, tokens)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
