"""All queries outside the training-data subpackage."""

from __future__ import annotations

from inkwarden.plans import compaction_queries, document_queries, upkeep_queries

MODULES = (document_queries, upkeep_queries, compaction_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: q for m in MODULES for name, q in m.SQL.items()}
FLAGSHIP = QUERIES["verdicts"]
