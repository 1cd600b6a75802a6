"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from sedgewing.llm import bpe, exact_dedup, html_text, mixing, near_dedup, quality_rules, repeated_spans, secret_scan, sharding, token_counts

MODULES = (quality_rules, mixing, token_counts, sharding, secret_scan, exact_dedup, bpe, near_dedup, html_text, repeated_spans)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
