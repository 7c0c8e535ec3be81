"""All core queries and their SQL, by name."""

from __future__ import annotations

from lexweave.plans import base, nested_queries, retrieval_queries, role_queries, segment_queries, statute_queries, stream_queries, text_queries  # noqa: F401

QUERIES: dict = {**base.QUERIES, **nested_queries.QUERIES}
ORACLES: dict = {**base.ORACLES, **nested_queries.ORACLES}
