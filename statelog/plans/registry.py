"""All queries of the core, and their SQL."""

from __future__ import annotations

from statelog.plans import calls, dependency, general, pipeline, proofs, scans, store

_MODULES = (general, store, proofs, dependency, pipeline, scans, calls)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
