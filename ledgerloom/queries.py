"""All queries of the engine, by name, and the same in SQL where SQL can say it."""

from . import catalogue, forest, records  # noqa: F401  (the last two add theirs)

QUERIES = catalogue.QUERIES
ORACLE_SQL = catalogue.ORACLE_SQL
