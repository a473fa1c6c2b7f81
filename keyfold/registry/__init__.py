"""Registered queries and their SQL twins, gathered from the modules of this folder."""

from keyfold.registry import feature_queries, model_queries, row_queries, text_queries
from keyfold.registry.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "feature_queries", "model_queries", "row_queries", "text_queries"]
