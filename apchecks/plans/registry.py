"""All registered queries with their SQL."""

from __future__ import annotations

from . import checks, decisions, evidence_queries, extra, interpret_queries, operations_queries, recheck_queries, review_queries


def merged(*parts: dict) -> dict:
    """One dictionary of all parts; a name that stands in two of them is an error, since one would hide the other."""
    out: dict = {}
    for part in parts:
        twice = out.keys() & part.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= part
    return out


_PARTS = (checks, decisions, operations_queries, extra, review_queries, evidence_queries, interpret_queries, recheck_queries)
QUERIES = merged(*(p.QUERIES for p in _PARTS))
ORACLES = merged(*(p.ORACLES for p in _PARTS))
