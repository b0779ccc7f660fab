"""Every query of the library proper."""

from __future__ import annotations

from lacuna.plans import aggregates, basic, composite, embedding_queries, file_queries, reports, sequence_queries, statistics_queries  # noqa: F401
from lacuna.plans.registry import ORACLE, QUERIES


def queries():
    return QUERIES


def oracle_sql():
    return ORACLE
