"""Queries over the reference's operators and their SQL."""

from __future__ import annotations

from tessera.plans import chunked, chunking, dialogue, extraction, facts, feeds, layouts, lookups, markup_rows, panes, ranking, readings, records, relational, retrieval, routing, stored, streamed, texts
from tessera.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "chunked", "chunking", "dialogue", "extraction", "facts", "feeds", "layouts", "lookups", "markup_rows", "panes", "ranking", "readings", "records", "relational", "retrieval", "routing", "stored", "streamed", "texts"]
