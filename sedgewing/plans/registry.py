"""All queries over the driver's tables and the SQL that each must agree with."""

from __future__ import annotations

import importlib

MODULES = ("records", "columns", "joins", "aggregates", "orders", "graphs", "texts", "streams", "more", "files", "numbers", "forms", "blocks")


def _books() -> list:
    return [importlib.import_module(f"sedgewing.plans.{m}").BOOK for m in MODULES]


def queries() -> dict:
    return {k: f for b in _books() for k, f in b.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for b in _books() for k, s in b.oracle.items()}
