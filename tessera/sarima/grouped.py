"""The order search for every series of a panel, dealt to tasks by cost; failures stay with their series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..storage import materialize
from .packing import cost, packed
from .search import missing, search

SCHEMA = "ts_id string, variable string, sample string, time_d date, pred double, p int, d int, q int, seasonal_p int, seasonal_d int, seasonal_q int, season int, include_intercept boolean, cost double, failure string"
Horizons = dict[str, tuple[int, int, int]]
BOUNDS = (5, 5, 2, 2)
#: Tasks for each core that the session counts on, where none are given.
TASKS_A_CORE = 4


def series_rows(stacked: DataFrame, params: DataFrame) -> DataFrame:
    """One row for each series and variable: its days and values in order, and its parameters (NULL where it has none)."""
    pairs = F.sort_array(F.collect_list(F.struct("time_d", F.col("y").cast("double").alias("y"))))
    arrays = stacked.groupBy("ts_id", "variable").agg(pairs.alias("pairs"))
    arrays = arrays.select("ts_id", "variable", F.transform("pairs", lambda x: x["time_d"]).alias("days"), F.transform("pairs", lambda x: x["y"]).alias("ys"))
    return arrays.join(params.select("ts_id", "variable", "found_stn", "func", "d", "seasonal_d", "S"), ["ts_id", "variable"], "left")


def planned(stacked: DataFrame, params: DataFrame, most: tuple[int, int, int, int] = BOUNDS, tasks: int | None = None) -> tuple[DataFrame, int]:
    """series_rows(), each with the task that fits it, and the number of tasks."""
    rows, _ = materialize(series_rows(stacked, params).withColumn("cost", cost(F.size("ys"), F.col("S"), F.col("found_stn"), most)), "series")
    if tasks is None:
        tasks = TASKS_A_CORE * stacked.sparkSession.sparkContext.defaultParallelism
    return packed(rows, tasks)


def fit_planned(rows: DataFrame, tasks: int, horizons: Horizons, most: tuple[int, int, int, int] = BOUNDS, most_rounds: int = 1000) -> DataFrame:
    """The samples of every row of planned(): task k is partition k, whatever adaptive execution would merge."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                yield fit_row(row, *horizons[row.variable], most, most_rounds)

    return rows.repartitionById(tasks, F.col("task")).mapInPandas(fit, SCHEMA)


def fit_row(row, n_validation: int, n_forecast: int, step_days: int, most: tuple[int, int, int, int], most_rounds: int) -> pd.DataFrame:
    """One series -> its samples. What can't be fitted has NULL predictions of the same shape and a reason in failure."""
    days, y = list(row.days), np.array(row.ys, float)
    seen = np.flatnonzero(~np.isnan(y))
    if len(seen):
        days, y = days[seen[0] :], y[seen[0] :]
    held, found, failure = min(n_validation, len(days)), None, None
    if not len(seen):
        failure = "no values"
    elif np.isnan(y).any() or any((b - a).days != step_days for a, b in zip(days[:-1], days[1:], strict=True)):
        failure = "gap"
    elif len(days) <= n_validation:
        failure = "too short"
    elif row.found_stn is None or pd.isna(row.found_stn) or not row.found_stn:
        failure = "no stationary form"
    else:
        try:
            found = search(y, int(row.d), int(row.seasonal_d), int(row.S), held, n_forecast, use_log=row.func == "log", most=most, most_rounds=most_rounds)
            if found.order is None:
                failure = "no model"
        except (ArithmeticError, ValueError, IndexError, np.linalg.LinAlgError) as error:
            found, failure = None, f"numeric: {type(error).__name__}: {error}"
    found = found or missing(len(y), held, n_forecast)
    ahead = [days[-1] + pd.Timedelta(days=step_days * (k + 1)) for k in range(n_forecast)]
    samples = [("fitted", days, found.fitted), ("valicast", days[len(days) - held :], found.valicast), ("forecast", ahead, found.forecast)]
    o = found.order
    out = pd.concat([pd.DataFrame({"sample": s, "time_d": t, "pred": v}) for s, t, v in samples], ignore_index=True)
    out.insert(0, "ts_id", row.ts_id)
    out.insert(1, "variable", row.variable)
    for name, attribute in (("p", "p"), ("d", "d"), ("q", "q"), ("seasonal_p", "P"), ("seasonal_d", "D"), ("seasonal_q", "Q"), ("season", "S")):
        out[name] = pd.array([None if o is None else getattr(o, attribute)] * len(out), dtype="Int32")
    out["include_intercept"] = pd.array([None if o is None else o.has_mean] * len(out), dtype="boolean")
    out["cost"] = found.cost
    out["failure"] = pd.array([failure] * len(out), dtype="string")
    return out


def fit_variables(stacked: DataFrame, params: DataFrame, horizons: Horizons, most: tuple[int, int, int, int] = BOUNDS, most_rounds: int = 1000, tasks: int | None = None) -> DataFrame:
    """stacked (ts_id, variable, time_d, y) and params (ts_id, variable, found_stn, func, d, seasonal_d, S) -> samples of every variable.

    horizons: variable -> (values held for validation, forecast steps, days a step). Values before a series' first are left out;
    a series without values, with a gap, no longer than its validation or without a model gets NULLs and a reason.
    """
    rows, tasks = planned(stacked, params, most, tasks)
    return fit_planned(rows, tasks, horizons, most, most_rounds)


def fit_panel(panel: DataFrame, params: DataFrame, value: str, n_validation: int = 60, n_forecast: int = 70, step_days: int = 1, most: tuple[int, int, int, int] = BOUNDS, most_rounds: int = 1000, tasks: int | None = None) -> DataFrame:
    """panel (ts_id, time_d, value) and params (ts_id, found_stn, func, d, seasonal_d, S) -> samples fitted, valicast and forecast."""
    stacked = panel.select("ts_id", F.lit(value).alias("variable"), "time_d", F.col(value).alias("y"))
    return fit_variables(stacked, params.withColumn("variable", F.lit(value)), {value: (n_validation, n_forecast, step_days)}, most, most_rounds, tasks)


def specification(fitted: DataFrame) -> DataFrame:
    """One row for each series: its order and cost, or why it has none."""
    return fitted.select("ts_id", "variable", "p", "d", "q", "seasonal_p", "seasonal_d", "seasonal_q", "season", "include_intercept", "cost", "failure").distinct()


def failures(fitted: DataFrame) -> DataFrame:
    """ts_id, variable and failure of the series without a model."""
    return fitted.where("failure is not null").select("ts_id", "variable", "failure").distinct()
