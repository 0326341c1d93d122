"""Named queries over the driver's tables, each with its ANSI SQL twin where one exists."""

from __future__ import annotations

from importlib import import_module

from urlsieve.plans.registry import QUERIES, TWINS, Query

MODULES = (
    "url_queries", "profile_queries", "split_queries", "metric_queries", "feed_queries", "page_queries",
    "model_queries", "scan_queries",
)


def _load() -> None:
    for name in MODULES:
        import_module(f"urlsieve.plans.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_twins() -> dict[str, str]:
    _load()
    return dict(TWINS)
