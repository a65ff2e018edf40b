"""All queries of the evaluation operators by name, and their SQL."""

from lumenfold.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
