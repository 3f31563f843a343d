"""Every registered query with its SQL counterpart."""

from __future__ import annotations

from tidewatch.plans import articles, desk, figures, news, operations, stores, streams  # noqa: F401  they register their queries
from tidewatch.plans.tables import REGISTRY, Query


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
