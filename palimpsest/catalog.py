"""The registered queries of the versioned-table operators, and the SQL that must give the same rows."""

from __future__ import annotations

from palimpsest.plans import stores  # noqa: F401  adds its queries
from palimpsest.plans.queries import QUERIES, SQL
