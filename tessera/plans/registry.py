"""All registered queries."""

from __future__ import annotations

from . import basics, fitted, forecasts  # noqa: F401  the others add their own

QUERIES = dict(basics.QUERIES)
SQL = dict(basics.SQL)
