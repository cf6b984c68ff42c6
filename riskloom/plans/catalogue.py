"""Imports every module that registers queries."""

from riskloom.plans import (  # noqa: F401
    metric_queries,
    monitor_queries,
    profile_queries,
    scoring_queries,
    source_queries,
    stream_queries,
    text_queries,
    training_queries,
    web_queries,
)
from riskloom.plans.registry import ENTRIES

__all__ = ["ENTRIES"]
