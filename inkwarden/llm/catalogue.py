"""All queries of the subpackage."""

from __future__ import annotations

from inkwarden.llm import p2, p3, p4, p5, p6, p7, p8, p9

MODULES = (p2, p3, p4, p5, p6, p7, p8, p9)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: q for m in MODULES for name, q in m.SQL.items()}
