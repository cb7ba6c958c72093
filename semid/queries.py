"""Registry of the library's queries and their SQL."""

from __future__ import annotations

from semid.plans import definition_queries, episode_queries, evaluation_queries, graph_queries, platform_queries, quantize_queries, retrieval_queries, sampling_queries, sequence_queries, source_queries, text_queries

GROUPS = (quantize_queries, sequence_queries, retrieval_queries, text_queries, graph_queries, sampling_queries, episode_queries, definition_queries, platform_queries, evaluation_queries, source_queries)
QUERIES = {name: query for group in GROUPS for name, query in group.QUERIES.items()}
ORACLES = {name: sql for group in GROUPS for name, sql in group.ORACLES.items()}
