"""Queries and SQL of the core operators, by name."""

from __future__ import annotations

from textquarry.operators import answers, corpus, evaluation, ingest, metadata, packing, questions, search, structure, tables

MODULES = [search, metadata, corpus, packing, structure, answers, questions, evaluation, tables, ingest]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
