"""Named queries and their oracle SQL."""

from . import models, oracles, queries, refits, reports, variants

QUERIES = queries.QUERIES | reports.QUERIES | models.QUERIES | refits.QUERIES | variants.QUERIES
ORACLES = oracles.ORACLES | reports.ORACLES | models.ORACLES | refits.ORACLES | variants.ORACLES

__all__ = ["ORACLES", "QUERIES"]
