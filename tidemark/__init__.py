"""Intraday cumulative metrics on Spark."""

from tidemark.plans.cumulative import cumulative
from tidemark.spec import ALL_LABEL, DimLabel, MetricSpec, kept_sets

__all__ = ["ALL_LABEL", "DimLabel", "MetricSpec", "cumulative", "kept_sets"]
