"""Stepwise search for the order of a seasonal ARIMA with a hold-out or information criterion."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np

from .kernel import Fit, Order

LEAST_ROOT, MOST_ROUNDS = 1.001, 1000


@dataclass
class Found:
    order: Order | None
    cost: float
    fitted: np.ndarray
    forecast: np.ndarray
    valicast: np.ndarray


def smape(f: np.ndarray, a: np.ndarray) -> float:
    both = ~(np.isnan(f) | np.isnan(a))
    f, a = f[both], a[both]
    if not len(f):
        return math.nan
    half = (np.abs(a) + np.abs(f)) / 2
    return float(100 * np.mean(np.divide(np.abs(f - a), half, out=np.zeros_like(half), where=half > 0)))


def mse(f: np.ndarray, a: np.ndarray) -> float:
    return float(np.nanmean((f - a) ** 2))


def neighbours(o: Order, most: tuple[int, int, int, int]) -> list[Order]:
    """One order up or down, both of a pair up or down, and the constant switched."""
    moves = [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (1, 1, 0, 0), (0, 0, 1, 1)]
    out = []
    for m in [*moves, *(tuple(-x for x in m) for m in moves)]:
        new = (o.p + m[0], o.q + m[1], o.P + m[2], o.Q + m[3])
        if all(0 <= x <= top for x, top in zip(new, most, strict=True)) and (o.S > 1 or new[2] == new[3] == 0):
            out.append(replace(o, p=new[0], q=new[1], P=new[2], Q=new[3]))
    return [*out, replace(o, const=1 - o.const)]


def search(y: np.ndarray, d: int, D: int, S: int, n_validation: int = 60, n_forecast: int = 70, cost: str = "smape", use_log: bool = False, most: tuple[int, int, int, int] = (5, 5, 2, 2), most_rounds: int = MOST_ROUNDS) -> Found:  # noqa: N803
    """Starts from four orders and moves to the best neighbour until nothing improves.

    cost: smape or mse on the last n_validation values, or aic (then n_validation must be 0). In the first round without more
    than one difference the next orders all lose their constant and the search goes on even without a gain.
    """
    if cost not in ("smape", "mse", "aic") or min(n_validation, n_forecast) < 0 or (cost == "aic") != (n_validation == 0):
        raise ValueError("cost and n_validation don't fit together")
    y = np.asarray(y, float)
    there = into = y
    if use_log:
        into = np.log(np.where(y == 0, 1.0, np.maximum(y, 1e-9)))
    back = np.exp if use_log else (lambda x: x)
    head = into[: len(into) - n_validation]
    held = there[len(there) - n_validation :] if n_validation else np.zeros(0)
    own = head[~np.isnan(head)]
    const = 0 if d + D > 1 else 1
    grid = [Order(p, d, q, P, D, Q, S, const) for p, q, P, Q in ((2, 2, 1, 1), (0, 0, 0, 0), (1, 0, 1, 0), (0, 1, 0, 1))]
    if S <= 1:
        grid = [replace(o, P=0, D=0, Q=0) for o in grid]
    grid, tried = list(dict.fromkeys(grid)), set()
    best: tuple[float, Order, Fit, np.ndarray] | None = None
    for turn in range(most_rounds):
        gained = False
        for o in grid:
            tried.add(o)
            try:
                fit = Fit(own, o)
                if fit.smallest_root() < LEAST_ROOT:
                    continue
                ahead = back(fit.forecast(n_validation)) if n_validation else np.zeros(0)
                value = fit.aic if cost == "aic" else {"smape": smape, "mse": mse}[cost](ahead, held)
            except (ValueError, np.linalg.LinAlgError, FloatingPointError):
                continue
            if np.isfinite(value) and (best is None or value < best[0]):
                best, gained = (value, o, fit, ahead), True
        forced = turn == 0 and d + D <= 1
        if best is None and turn == 0 and (again := [replace(o, const=0) for o in grid if o.const]) and d + D == 0:
            grid = again  # no start with a constant could be fitted: the same ones without it
            continue
        if best is None or not (gained or forced):
            break
        grid = neighbours(best[1], most)
        grid = [o for o in grid if o not in tried]
        if forced:
            grid = [o for o in dict.fromkeys(replace(o, const=0) for o in grid) if o not in tried]
        if not grid:
            break
    if best is None:
        return missing(len(y), n_validation, n_forecast)
    value, o, fit, ahead = best
    whole = into[~np.isnan(into)]
    try:
        final = Fit(whole, o)
        if not np.isfinite(final.forecast(n_forecast)).all():
            raise ValueError("no finite forecast")
    except (ValueError, np.linalg.LinAlgError):
        final = Fit(whole, o, params=fit.params)
    fitted = np.full(len(y), np.nan)
    fitted[~np.isnan(into)] = back(final.fitted())
    return Found(o, value, fitted, back(final.forecast(n_forecast)), ahead)


def missing(n: int, n_validation: int, n_forecast: int) -> Found:
    """The shape of a result for a series without a model."""
    return Found(None, math.nan, np.full(n, np.nan), np.full(n_forecast, np.nan), np.full(n_validation, np.nan))
