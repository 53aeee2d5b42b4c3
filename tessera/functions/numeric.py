"""Guarded arithmetic; missing is NULL throughout, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def one_for_zero(x: Column) -> Column:
    """1 in the place of 0, for numerators and denominators of ratios and for logarithms."""
    return F.when(x == 0, F.lit(1.0)).otherwise(x)


def without_negative(x: Column) -> Column:
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def least_or_null(x: Column, limit: Column) -> Column:
    """The smaller one; NULL if either is (least() would skip it)."""
    return F.when(x.isNotNull() & limit.isNotNull(), F.least(x, limit))


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def _present(columns: list[Column]) -> Column:
    return F.filter(F.array(*columns), lambda x: x.isNotNull())


def row_mean(columns: list[Column]) -> Column:
    """Mean over the columns that are not NULL, from the first to the last."""
    own = _present(columns)
    return F.try_divide(F.aggregate(own, F.lit(0.0), lambda a, x: a + x), F.size(own).cast("double"))


def row_median(columns: list[Column]) -> Column:
    """Median over the columns that are not NULL."""
    own = F.array_sort(_present(columns))
    n = F.size(own)
    low, high = F.get(own, F.floor((n - 1) / 2).cast("int")), F.get(own, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def smape(forecast: Column, actual: Column) -> Column:
    """Aggregate: 100 * mean of |F - A| / ((|A| + |F|) / 2) over rows with both; 0 where both are 0; NULL without such rows."""
    error = F.when((forecast == 0) & (actual == 0), F.lit(0.0)).when(forecast.isNotNull() & actual.isNotNull(), F.abs(forecast - actual) / ((F.abs(actual) + F.abs(forecast)) / 2))
    return F.avg(error) * 100


def mse(forecast: Column, actual: Column) -> Column:
    """Aggregate: mean squared error over rows with both."""
    return F.avg((forecast - actual) * (forecast - actual))
