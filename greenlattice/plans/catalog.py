"""Imports every query module and exposes the filled catalogue."""

from greenlattice.plans import (  # noqa: F401
    feature_queries, model_queries, report_queries, spatial_queries, validation_queries)
from greenlattice.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
