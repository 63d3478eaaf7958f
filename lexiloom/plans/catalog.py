"""All queries of the vocabulary operators. Importing the modules registers them."""

from __future__ import annotations

from lexiloom.plans import curate, match, pages, published, resolve, rules, schema, textual  # noqa: F401
from lexiloom.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
