"""The named queries of the library and their SQL oracles."""

from __future__ import annotations

from lexora.plans import entities, evidence, operations, records, values, workflow  # noqa: F401  register their queries
from lexora.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
