"""All registered queries of the engine's own operators."""

from . import queries_build, queries_more, queries_plans, queries_sim  # noqa: F401
from .queries import FLAGSHIP, ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
