"""Seasonal ARIMA fitted by conditional sum of squares (Box and Jenkins), in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Order:
    p: int
    d: int
    q: int
    P: int
    D: int
    Q: int
    S: int
    const: int = 1

    @property
    def has_mean(self) -> bool:
        return bool(self.const) and self.d + self.D == 0

    @property
    def size(self) -> int:
        return self.p + self.q + self.P + self.Q + self.has_mean


def polynomial(own: np.ndarray, seasonal: np.ndarray, season: int, sign: float) -> np.ndarray:
    """Coefficients of (1 + sign * own(B)) * (1 + sign * seasonal(B ** season)), constant first."""
    a, b = np.r_[1.0, sign * own], np.zeros(len(seasonal) * season + 1)
    b[0] = 1.0
    for k, v in enumerate(seasonal):
        b[(k + 1) * season] = sign * v
    return np.convolve(a, b)


def differencing(o: Order) -> np.ndarray:
    out = np.ones(1)
    for lag, times in ((1, o.d), (o.S, o.D)):
        step = np.zeros(lag + 1)
        step[0], step[lag] = 1.0, -1.0
        for _ in range(times):
            out = np.convolve(out, step)
    return out


class Inverse:
    """theta(B) e = a solved for e, with e = 0 before the start, for one series or several side by side.

    Blocks of BLOCK steps: within a block e is a triangular matrix times a; what the block before leaves is added from its end.
    """

    BLOCK = 64

    def __init__(self, theta: np.ndarray):
        self.q = q = len(theta) - 1
        if not q:
            return
        self.block = b = max(self.BLOCK, q)
        back, psi = theta[1:], np.zeros(b)
        psi[0] = 1.0
        for t in range(1, b):
            k = min(t, q)
            psi[t] = -(back[:k] @ psi[t - k : t][::-1])
        lag = np.arange(b)[:, None] - np.arange(b)[None, :]
        self.inside = np.where(lag >= 0, psi[np.maximum(lag, 0)], 0.0)
        ahead = np.arange(q)[:, None] + q - np.arange(q)[None, :]  # steps from the place c of the tail to the row r of the block
        reach = np.zeros((b, q))
        reach[:q] = np.where(ahead <= q, theta[np.minimum(ahead, q)], 0.0)
        self.over = self.inside @ reach

    def __call__(self, a: np.ndarray) -> np.ndarray:
        if not self.q:
            return a
        n, b = len(a), self.block
        wide = a.reshape(n, -1)
        k = wide.shape[1]
        full = np.zeros((-(-n // b) * b, k))
        full[:n] = wide
        out = (self.inside @ full.reshape(-1, b, k)).reshape(len(full), k)
        for low in range(b, len(full), b):
            out[low : low + b] -= self.over @ out[low - self.q : low]
        return out[:n].reshape(a.shape)


class Fit:
    """Parameters, residuals and polynomials of one order on one series."""

    def __init__(self, y: np.ndarray, order: Order, params: np.ndarray | None = None, rounds: int = 12):
        self.y, self.order = np.asarray(y, float), order
        self.diff = differencing(order)
        self.w = np.convolve(self.y, self.diff, "valid") if len(self.y) >= len(self.diff) else np.zeros(0)
        if len(self.w) < order.size + order.p + order.P * order.S + 5:
            raise ValueError("too few observations")
        self.params = self._estimate(rounds) if params is None else params
        self.e = self._residuals(self.params)
        used = max(1, len(self.e))
        self.sigma2 = float(self.e @ self.e) / used
        if not np.isfinite(self.sigma2):
            raise ValueError("no finite fit")
        self.loglik = -used / 2 * (np.log(2 * np.pi * max(self.sigma2, 1e-300)) + 1)
        self.aic = 2 * (order.size + 1) - 2 * self.loglik

    def _parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        o, at = self.order, 0
        pieces = []
        for n in (o.p, o.q, o.P, o.Q):
            pieces.append(x[at : at + n])
            at += n
        ar, ma, sar, sma = pieces
        return polynomial(ar, sar, o.S, -1.0), polynomial(ma, sma, o.S, 1.0), float(x[at]) if o.has_mean else 0.0

    def _residuals(self, x: np.ndarray) -> np.ndarray:
        phi, theta, mean = self._parts(x)
        return Inverse(theta)(np.convolve(self.w - mean, phi, "valid"))

    def _jacobian(self, x: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Derivatives of the residuals by each parameter: filtered lags of the series and of the residuals themselves."""
        o, at = self.order, 0
        parts = []
        for n in (o.p, o.q, o.P, o.Q):
            parts.append(x[at : at + n])
            at += n
        ar, ma, sar, sma = parts
        none = np.zeros(0)
        phi, theta, mean = self._parts(x)
        w, m = self.w - mean, len(e)
        by_sar, by_ar = (np.convolve(w, polynomial(a, b, o.S, -1.0))[: len(w)] for a, b in ((none, sar), (ar, none)))
        by_sma, by_ma = (np.convolve(e, polynomial(a, b, o.S, 1.0))[:m] for a, b in ((none, sma), (ma, none)))
        first = len(w) - m
        back = lambda v, lag: np.r_[np.zeros(min(lag, m)), v[: max(0, m - lag)]]
        columns = [-by_sar[first - i : len(w) - i] for i in range(1, o.p + 1)] + [-back(by_sma, j) for j in range(1, o.q + 1)]
        columns += [-by_ar[first - o.S * i : len(w) - o.S * i] for i in range(1, o.P + 1)] + [-back(by_ma, o.S * j) for j in range(1, o.Q + 1)]
        if o.has_mean:
            columns.append(np.full(m, -phi.sum()))
        return Inverse(theta)(np.column_stack(columns))

    def _start(self) -> np.ndarray:
        """Least squares on lags and on the residuals of a long autoregression (Hannan and Rissanen 1982)."""
        o, mean = self.order, float(self.w.mean()) if self.order.has_mean else 0.0
        w = self.w - mean
        n = len(w)
        long = min(n // 4, max(o.p + o.q, o.S * (o.P + o.Q), 1) + 4)
        lags = lambda v, ks, low: np.column_stack([v[low - k : n - k] for k in ks]) if ks else np.zeros((n - low, 0))
        x = lags(w, list(range(1, long + 1)), long)
        e = np.zeros(n)
        e[long:] = w[long:] - x @ np.linalg.lstsq(x, w[long:], rcond=None)[0]
        ar = [*range(1, o.p + 1), *(o.S * k for k in range(1, o.P + 1))]
        ma = [*range(1, o.q + 1), *(o.S * k for k in range(1, o.Q + 1))]
        low = min(n - 2, long + max([0, *ma]))
        low = max(low, max([0, *ar]))
        both = np.column_stack([lags(w, ar, low), lags(e, ma, low)])
        b = np.linalg.lstsq(both, w[low:], rcond=None)[0] if both.shape[1] else np.zeros(0)
        b = np.clip(b, -0.9, 0.9)
        ar_n, sar_n = b[: o.p], b[o.p : o.p + o.P]
        ma_n, sma_n = b[o.p + o.P : o.p + o.P + o.q], b[o.p + o.P + o.q :]
        return np.r_[ar_n, ma_n, sar_n, sma_n, [mean] if o.has_mean else []]

    def _estimate(self, rounds: int) -> np.ndarray:
        """Damped Gauss-Newton steps."""
        x = self._start()
        with np.errstate(all="ignore"):
            e = self._residuals(x)
            if not np.isfinite(e @ e) or e @ e > self.w @ self.w * 10:
                x = np.zeros_like(x)
                if self.order.has_mean:
                    x[-1] = self.w.mean()
                e = self._residuals(x)
            best, damp = float(e @ e), 1e-3
            for _ in range(rounds if len(x) else 0):
                jac = self._jacobian(x, e)
                if not np.isfinite(jac).all():
                    break
                moved = False
                for _ in range(5):
                    a = jac.T @ jac
                    step = np.linalg.solve(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), -jac.T @ e)
                    trial = self._residuals(x + step)
                    total = float(trial @ trial)
                    if np.isfinite(total) and total < best:
                        gain, x, e, best, damp, moved = best - total, x + step, trial, total, damp / 5, True
                        break
                    damp *= 10
                if not moved or gain < 1e-7 * best:
                    break
        return x

    def smallest_root(self) -> float:
        """Least modulus of the roots of either polynomial."""
        phi, theta, _ = self._parts(self.params)
        found = [np.abs(np.roots(c[::-1])) for c in (np.trim_zeros(phi, "b"), np.trim_zeros(theta, "b")) if len(c) > 1]
        return float(min([np.inf, *(r.min() for r in found if len(r))]))

    def fitted(self) -> np.ndarray:
        """One-step predictions, NaN where the start has none."""
        out = np.full(len(self.y), np.nan)
        out[len(self.y) - len(self.e) :] = self.y[len(self.y) - len(self.e) :] - self.e
        return out

    def forecast(self, steps: int) -> np.ndarray:
        phi, theta, mean = self._parts(self.params)
        whole = np.convolve(phi, self.diff)  # acts on y, with the mean's share as a constant
        constant = mean * phi.sum()
        y, e = list(self.y), list(np.r_[np.zeros(len(theta)), self.e])
        for _ in range(steps):
            past = np.array(y[-(len(whole) - 1) :][::-1]) if len(whole) > 1 else np.zeros(0)
            shocks = np.array(e[-(len(theta) - 1) :][::-1]) if len(theta) > 1 else np.zeros(0)
            y.append(constant - whole[1:] @ past + theta[1:] @ shocks)
            e.append(0.0)
        return np.array(y[len(self.y) :])
