"""All registered queries."""

from __future__ import annotations

from . import concepts, graphs, investment, models, reports, scalars, services, texts

MODULES = [investment, graphs, concepts, texts, models, scalars, services, reports]


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.S.items()}
