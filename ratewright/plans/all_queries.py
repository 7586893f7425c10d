"""Importing this module registers every query."""

from ratewright.plans import consensus_queries, cycle_queries, panel_queries, rating_queries, report_queries, served_queries, settle_queries, stream_queries, table_queries  # noqa: F401
from ratewright.plans.registry import CHECKS, QUERIES  # noqa: F401
