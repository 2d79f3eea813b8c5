"""Imports every module that registers queries."""

from riskloom.plans import analyses, forecast, learning, preparation, relational, texts  # noqa: F401
from riskloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
