"""All queries of the core library and their SQL, by name."""

from __future__ import annotations

from . import composites, crm, graph, retrieval, service, text

MODULES = (crm, text, retrieval, graph, service, composites)


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracles() -> dict:
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}
