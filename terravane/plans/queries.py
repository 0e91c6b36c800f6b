"""All queries on the star schema; importing it fills the registry."""

from terravane.plans import queries_dependence, queries_estimation, queries_kernels, queries_models, queries_more, queries_rest
from terravane.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "queries_dependence", "queries_estimation", "queries_kernels", "queries_models", "queries_more", "queries_rest"]
