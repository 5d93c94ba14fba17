"""All registered queries and their SQL, gathered from the families."""

from __future__ import annotations

from . import candidate_queries, file_queries, media_queries, table_queries, transcript_queries

_FAMILIES = (transcript_queries, candidate_queries, media_queries, table_queries, file_queries)

QUERIES = {name: q for family in _FAMILIES for name, q in family.QUERIES.items()}
ORACLES = {name: q for family in _FAMILIES for name, q in family.ORACLES.items()}
FLAGSHIP = "select_clips"
