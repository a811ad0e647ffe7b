"""All queries of the reference operators; importing the plan modules registers them."""

from __future__ import annotations

from loomstone.plans import (  # noqa: F401
    bpe_plans, cleaning_plans, conversation_plans, dedup_plans, evaluation_plans, mixture_plans, packing_plans, quality_plans,
    schedule_plans, stream_plans, vector_plans,
)
from loomstone.plans.registry import PLANS, SQL, Query


def queries() -> dict[str, Query]:
    return dict(PLANS)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
