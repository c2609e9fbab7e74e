"""All registered queries and their SQL twins."""

from __future__ import annotations

from skyledger.plans import events, graph, inventory, lof, lookups, projection, streams

FAMILIES = (lof, events, lookups, projection, graph, inventory, streams)

QUERIES = {name: fn for family in FAMILIES for name, fn in family.QUERIES.items()}
ORACLE = {name: sql for family in FAMILIES for name, sql in family.ORACLE.items()}
