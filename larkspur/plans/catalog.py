"""All queries of the core operators and their SQL."""

from __future__ import annotations

from larkspur.plans import curation, retrieval, texts, upkeep
from larkspur.plans.registry import Query

PARTS = (texts.R, retrieval.R, upkeep.R, curation.R)


def queries() -> dict[str, Query]:
    return {name: q for part in PARTS for name, q in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for part in PARTS for name, q in part.sql.items()}
