"""Importing this module registers every query."""

from tidegrid.plans import clusters, density, detect, geo, graph, grid, stats, streams, text, times  # noqa: F401
from tidegrid.plans.registry import ORACLES, QUERIES  # noqa: F401
