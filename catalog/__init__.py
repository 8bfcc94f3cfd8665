"""All registered queries and their oracles."""

from __future__ import annotations

from catalog.registry import ORACLES, QUERIES, Query


def _load() -> None:
    from catalog import indicators, models_scoring, sources_profiling, tables_features  # noqa: F401


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
