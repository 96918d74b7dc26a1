"""All registered queries of the timeline and sequence operators, and their DuckDB SQL."""

from . import gaussian_queries, interval_queries, language_queries, search_queries, signal_queries, source_queries, vector_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (interval_queries, vector_queries, gaussian_queries, language_queries, search_queries, signal_queries, source_queries):
    QUERIES |= _part.REGISTRY.queries
    ORACLES |= _part.REGISTRY.oracles
