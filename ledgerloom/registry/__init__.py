"""Every operator as a query over the given tables, with its SQL counterpart."""

from __future__ import annotations

from ledgerloom.registry import ledger_queries, return_queries, sheet_queries, statistics_queries
from ledgerloom.registry.base import Query

_MODULES = (ledger_queries, statistics_queries, sheet_queries, return_queries)


def all_queries() -> list[Query]:
    return [query for module in _MODULES for query in module.QUERIES]
