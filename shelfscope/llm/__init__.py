"""Operators of a training-data pipeline: ten methods over documents.

``queries()`` and ``oracle_sql()`` are what the driver's entry adds to its registry.
"""

from __future__ import annotations


def queries() -> dict:
    from shelfscope.llm import registry
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    from shelfscope.llm import registry
    return dict(registry.ORACLE)
