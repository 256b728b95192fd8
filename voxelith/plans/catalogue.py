"""Imports every query module so that the registry is complete."""

from voxelith.plans import array_queries, block_queries, graph_queries, metric_queries, score_queries, source_queries, volume_queries  # noqa: F401
from voxelith.plans.registry import ORACLES, QUERIES  # noqa: F401
