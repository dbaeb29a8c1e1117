"""Registered queries of the library's own operators and their DuckDB SQL."""

from __future__ import annotations

from . import deadline_plans, detail_plans, extract_plans, ingest_plans, match_plans, text_plans, time_plans  # noqa: F401
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
