"""All registered queries; importing the modules registers them."""

from __future__ import annotations

from . import (  # noqa: F401
    graph_queries,
    image_queries,
    large_queries,
    mosaic_queries,
    reply_queries,
    statistics_queries,
    table_queries,
)
from .registry import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
