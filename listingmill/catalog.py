"""All registered queries and their SQL."""

from __future__ import annotations

from listingmill.plans import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
