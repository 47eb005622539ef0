"""Every registered query of the triage library by name, and its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from muster.plans.views import duck

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``f(spark, sf_dir)`` under ``name``; ``sql`` may name the shared views."""

    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = duck(sql)
        return f

    return keep


def load() -> None:
    from muster.plans import q_metrics, q_quality, q_scan, q_scores, q_stream, q_tables, q_text  # noqa: F401


load()
