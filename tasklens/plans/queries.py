"""The registered queries over the job relations, each with its own SQL for DuckDB where that can express it."""

from __future__ import annotations

from tasklens.plans import change, inspect, measure

TABLE = inspect.TABLE | change.TABLE | measure.TABLE
QUERIES = {name: query for name, (query, _) in TABLE.items()}
SQL = {name: sql for name, (_, sql) in TABLE.items() if sql}
