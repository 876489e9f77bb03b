"""All registered queries of the library's own operators."""

from __future__ import annotations

from tiltyard.plans import models, reports, tables
from tiltyard.plans.tables import best_decks

QUERIES = {**tables.QUERIES, **reports.QUERIES, **models.QUERIES}
ORACLE = {**tables.ORACLE, **reports.ORACLE, **models.ORACLE}

__all__ = ["ORACLE", "QUERIES", "best_decks"]
