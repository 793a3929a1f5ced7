"""All queries of the engine's own operators, and their DuckDB SQL."""

from brindle.plans import record_queries, text_queries

QUERIES = text_queries.QUERIES | record_queries.QUERIES
SQL = text_queries.SQL | record_queries.SQL
