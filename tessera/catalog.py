"""All registered queries and the SQL that states their results."""

from .plans import labels, routing, searches, structure, trees, words
from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "labels", "routing", "searches", "structure", "trees", "words"]
