"""Registry of the engine's own queries and of the SQL that states the same result."""

from __future__ import annotations

from palisade.plans.branch_oracles import BRANCH_ORACLES
from palisade.plans.branch_queries import BRANCH_QUERIES
from palisade.plans.oracles import ORACLES
from palisade.plans.queries import QUERIES, Query, flagship

__all__ = ["flagship", "oracle_sql", "queries"]


def queries() -> dict[str, Query]:
    return {**QUERIES, **BRANCH_QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**ORACLES, **BRANCH_ORACLES}
