"""Named queries over the test tables, each with the SQL that must give the same rows.

Roles: an area is (customer nation, market segment); an order is an incident
whose code is its priority, with codes starting with 1 as targets; a line item
is an inspection by ship date; an order is also a lien of its year.
"""

from __future__ import annotations

from .base import QUERIES, SQL
from . import aggregates, domain, filters, joins, models, ordered, panels, scalars, schema, scores, scans  # noqa: F401

__all__ = ["QUERIES", "SQL"]
