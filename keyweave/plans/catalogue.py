"""The registered queries over the driver's tables, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from keyweave.plans import inventory_queries, lookup_queries, resolve_queries, text_queries
from keyweave.plans.registry import Query

FLAGSHIP = "resolve_top1"
_MODULES = (inventory_queries, lookup_queries, text_queries, resolve_queries)


def queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, q in m.REG.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.REG.sql.items()}
