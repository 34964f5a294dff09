"""Queries and SQL of the training-text operators, by name."""

from __future__ import annotations

from textquarry.llm import glyphs, leakage, mixing, neardup, neighbours, quality, scans, splitting

MODULES = [scans, glyphs, neighbours, splitting, neardup, leakage, mixing, quality]


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
