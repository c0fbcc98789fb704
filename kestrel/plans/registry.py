"""Registered queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from kestrel.plans import briefs, contracts, correlation, features, messages, networks, records, rings, streams

MODULES = (features, rings, correlation, messages, records, networks, streams, briefs, contracts)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
