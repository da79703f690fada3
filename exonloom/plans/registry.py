"""All queries of the core, with their SQL."""

from __future__ import annotations

from exonloom.plans import learning, problem1, scoring, sequences

MODULES = [scoring, sequences, learning, problem1]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
