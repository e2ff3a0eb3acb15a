"""Queries over the given tables, one per operator."""

from . import grids, hooks, matching, nodes, observations, profiles, scalars, sources  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
