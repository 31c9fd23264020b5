"""All registered queries and their DuckDB SQL, by name."""

from __future__ import annotations

from factloom.plans import aggregates, candidates, casework, context, identities, incremental, joins, matching, persons, reads, results, review, spans, streams, texts, unnamed, windows  # noqa: F401
from factloom.plans.base import QUERIES, SQL

FLAGSHIP = "candidates_absent_from_list"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
