"""All queries of the engine by name, and their SQL for the oracle."""

from __future__ import annotations

from glasshouse.plans import catalog_eval, catalog_sites, catalog_text

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (catalog_text, catalog_sites, catalog_eval):
    QUERIES |= _part.CATALOG.queries
    ORACLES |= _part.CATALOG.oracles
