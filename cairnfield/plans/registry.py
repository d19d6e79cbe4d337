"""Named queries of the point engine and the SQL that each must equal."""

from cairnfield.plans import curve_queries, history_queries, tree_queries  # noqa: F401
from cairnfield.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
