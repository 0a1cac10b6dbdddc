"""Names of the relational queries, with their Spark plans and their DuckDB counterparts."""

from __future__ import annotations

from psephon.plans import base, cleaning, contest, evaluation, features

MODULES = (cleaning, contest, evaluation, features)


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
