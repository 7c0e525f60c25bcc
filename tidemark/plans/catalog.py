"""All queries of the engine."""

from tidemark.plans import certificates, evaluation, fixtures, flows, models, more, population, recordings, relational, security, streams, studies, surface  # noqa: F401
from tidemark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
