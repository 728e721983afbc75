"""Queries of the operators in this subpackage, and the SQL to hold them against."""

from __future__ import annotations

from . import bpe, chat, dedup, divergence, fingerprints, html, jaccard, packing, pii, quality, runs, topk, warc

MODULES = (bpe, chat, dedup, divergence, fingerprints, html, jaccard, packing, pii, quality, runs, topk, warc)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
