"""Imports every query module so that the registry is complete."""

from slotwise.plans import base_queries, feature_queries, feed_queries, model_queries, report_queries, score_queries, stream_life_queries, stream_queries  # noqa: F401
from slotwise.plans.registry import QUERIES  # noqa: F401
