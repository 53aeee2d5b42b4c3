"""Checks for storage.materialize() and the table store: aggregates over a table's rows that must be true, in the pass that writes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.window import Window


def rows(n: int) -> dict[str, Column]:
    """A join by keys must keep the rows that went in."""
    return {f"{n} rows": F.count("*") == n}


def complete(*columns: str) -> dict[str, Column]:
    """No NULL in these columns, say the partner's mark after an outer join, or a plugged prediction."""
    return {f"{c} complete": F.count_if(F.col(c).isNull()) == 0 for c in columns}


def complete_where(column: str, given: str) -> dict[str, Column]:
    """No NULL in a column where another has a value."""
    return {f"{column} complete where {given} is": F.count_if(F.col(column).isNull() & F.col(given).isNotNull()) == 0}


def group_total(share: str, group: str) -> Column:
    """Sum of a share over its group: a column for adds_up()."""
    return F.sum(share).over(Window.partitionBy(group))


def adds_up(total: str, to: float = 1.0, tolerance: float = 1e-6) -> dict[str, Column]:
    """Group totals (NULL where there is nothing to share) are what they should be."""
    return {f"{total} adds up": F.coalesce(F.max(F.abs(F.col(total) - to)), F.lit(0.0)) <= tolerance}
