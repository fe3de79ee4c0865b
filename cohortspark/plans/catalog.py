"""Importing this module registers every query."""

from cohortspark.plans import behaviour, inference, relational, tables  # noqa: F401
from cohortspark.plans.registry import ORACLES, QUERIES  # noqa: F401
