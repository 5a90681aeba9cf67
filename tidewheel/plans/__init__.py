"""All queries of the relational engine, with their SQL."""

from __future__ import annotations

from tidewheel.plans import aggregate_plans, change_plans, filters, join_plans, scalar_plans, scans

QUERIES = {}
ORACLE = {}
for _module in (scans, filters, join_plans, aggregate_plans, scalar_plans, change_plans):
    QUERIES |= _module.plans.queries
    ORACLE |= _module.plans.oracle
