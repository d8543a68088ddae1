"""Query plans over the driver's tables: each is a DataFrame plan and, where SQL can say it, an oracle."""

from __future__ import annotations

from listingmill.plans import desk_queries, mail_queries, more_queries, pursuit_queries, relational_queries, resolve_queries, rule_queries, stream_queries, text_queries

_PARTS = (relational_queries, text_queries, rule_queries, resolve_queries, pursuit_queries, stream_queries, more_queries, mail_queries, desk_queries)
QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES: dict = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
