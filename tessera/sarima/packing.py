"""Fits dealt to tasks by what they will cost: the dearest first, each to the task with the least so far."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import numbered

#: Measured on series of 115 to 2,499 values: a search costs BASE seconds, grows by as much in FLAT values, and costs SEASONAL
#: times as much with a season; a series without a stationary form costs IDLE.
BASE, FLAT, SEASONAL, IDLE = 0.11, 2500, 2.5, 0.01
#: Costs in one class differ by at most 1 / STEPS of their size, so there are few classes however many fits.
STEPS = 25


def cost(length: Column, season: Column, found: Column, most: tuple[int, int, int, int]) -> Column:
    """Predicted seconds of a search by length, season and bounds of the orders."""
    grid = (1 + most[0] + most[1]) / 11
    seasonal = 1 + (SEASONAL - 1) * (most[2] + most[3]) / 4
    own = BASE * (0.5 + 0.5 * grid) * (1 + length / F.lit(FLAT)) * F.when(season > 1, seasonal).otherwise(1.0)
    return F.when(F.coalesce(found, F.lit(False)), own).otherwise(F.lit(IDLE))


def deal(classes: list[tuple[float, int]], tasks: int) -> list[np.ndarray]:
    """For each (cost, number of fits), dearest first: how many of them each task gets, so that loads end up level."""
    loads, out = np.zeros(tasks), []
    for each, n in classes:
        order = np.sort(loads)
        level = next(x for k in range(tasks, 0, -1) if (x := (order[:k].sum() + n * each) / k) >= order[k - 1])
        given = np.floor(np.maximum(0, level - loads) / each + 1e-9).astype(np.int64)
        given[np.argsort(-given, kind="stable")[: max(0, int(given.sum()) - n)]] -= 1  # rounding gave one too many
        loads += given * each
        rest = np.argsort(loads, kind="stable")[: n - int(given.sum())]
        given[rest] += 1
        loads[rest] += each
        out.append(given)
    return out


def packed(series: DataFrame, tasks: int, keys: tuple[str, ...] = ("ts_id", "variable")) -> tuple[DataFrame, int]:
    """series (a written table with keys and cost) with task, and the number of tasks: as asked for, but no more than series.

    Only the classes' counts reach the driver; only keys are ranked, not what the series hold.
    """
    own = series.select(*keys, (-F.ceil(F.log(F.greatest("cost", F.lit(1e-6))) * STEPS)).cast("int").alias("__class"))
    counted = own.groupBy("__class").agg(F.count("*").alias("n")).orderBy("__class").collect()
    tasks = max(1, min(tasks, sum(r["n"] for r in counted)))
    given = deal([(float(np.exp(-r["__class"] / STEPS)), r["n"]) for r in counted], tasks)
    rows = []
    for r, g in zip(counted, given, strict=True):
        some = np.flatnonzero(g)
        rows.append((r["__class"], np.concatenate(([0], np.cumsum(g[some])[:-1])).astype(int).tolist(), some.tolist()))
    plan = series.sparkSession.createDataFrame(rows, "__class int, __starts array<long>, __tasks array<int>")
    placed = numbered(own, list(keys), ("__class",), "__rank").join(F.broadcast(plan), "__class")
    at = F.size(F.filter("__starts", lambda s: s <= F.col("__rank"))) - 1
    return series.join(placed.select(*keys, F.get("__tasks", at).alias("task")), list(keys)), tasks
