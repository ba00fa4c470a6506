"""Named queries over the given tables, each with its DuckDB counterpart where SQL can express it."""

from corpusloom.plans import quality, records, search

QUERIES: dict = search.QUERIES | quality.QUERIES | records.QUERIES
ORACLE_SQL: dict[str, str] = search.ORACLE_SQL | quality.ORACLE_SQL | records.ORACLE_SQL
