"""Registered queries: each module holds QUERIES and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("pit", "quality", "signals", "metrics", "ledger", "enrich", "model", "scalar", "reference", "landing")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"tidemark.plans.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
