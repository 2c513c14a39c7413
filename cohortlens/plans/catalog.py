"""All registered queries."""

from . import (  # noqa: F401
    cohort_queries,
    scalar_queries,
    join_queries,
    aggregate_queries,
    window_queries,
    dimensional_queries,
    lake_queries,
    change_queries,
    search_queries,
    quality_queries,
)
from .registry import PLANS

__all__ = ["PLANS"]
