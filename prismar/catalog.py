"""The registered queries of the library, by the ids of the operator inventory, and the SQL that each is held against."""

from __future__ import annotations

from prismar.plans import cluster_queries, io_queries, point_queries, raster_queries, scalar_queries, search_queries
from prismar.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cluster_queries", "io_queries", "point_queries", "raster_queries", "scalar_queries", "search_queries"]
