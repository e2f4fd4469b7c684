"""Imports every plan module so that its queries are registered."""

from tidemark.plans import credit, jobs, models, recommender, streams, text  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
