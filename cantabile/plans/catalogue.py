"""All queries of the timed-text engine by name, and the same in SQL where SQL can say it."""

from __future__ import annotations

from cantabile.plans import align_queries, ordered_queries, text_queries

QUERIES = {**ordered_queries.QUERIES, **text_queries.QUERIES, **align_queries.QUERIES}
ORACLES = {**ordered_queries.ORACLES, **text_queries.ORACLES, **align_queries.ORACLES}
