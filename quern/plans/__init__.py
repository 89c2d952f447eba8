"""All queries of the library (importing the modules registers them)."""

from quern.plans import classes, models, text  # noqa: F401
from quern.plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
