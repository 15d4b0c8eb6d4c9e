"""Whole runs and the catalog of registered queries; importing the package registers them all."""

from graphloom.plans import build_queries, catalog, engine_queries, node_queries, source_queries  # noqa: F401
