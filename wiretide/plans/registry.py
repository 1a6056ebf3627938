"""All queries of the flow operators and their SQL."""

from __future__ import annotations

from wiretide.plans import basics, details, experiments, offline, relational, streams

MODULES = (basics, relational, offline, experiments, details, streams)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
