"""All queries of the graph engine, and the SQL that gives the same rows."""

from .plans import growth_queries, model_queries, packing_queries, stream_queries, structure_queries, walk_queries

_MODULES = (structure_queries, model_queries, growth_queries, stream_queries, walk_queries, packing_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
