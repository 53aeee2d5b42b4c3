import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sarima import grouped, ledger, packing, search
from tessera.sarima.kernel import Fit, Inverse, Order


def test_recovers_an_autoregression():
    rng = np.random.default_rng(5)
    y = np.zeros(1500)
    for t in range(1, 1500):
        y[t] = 0.6 * y[t - 1] + rng.normal()
    fit = Fit(y + 10, Order(1, 0, 0, 0, 0, 0, 7))
    assert fit.params[0] == pytest.approx(0.6, abs=0.06) and fit.params[1] == pytest.approx(10, abs=0.4)


def test_recovers_a_moving_average():
    e = np.random.default_rng(6).normal(size=1500)
    fit = Fit(e[1:] + 0.5 * e[:-1], Order(0, 0, 1, 0, 0, 0, 1, 0))
    assert fit.params[0] == pytest.approx(0.5, abs=0.06)


def test_random_walk_and_seasonal_walk_forecasts():
    y = np.random.default_rng(7).normal(size=100).cumsum()
    assert Fit(y, Order(0, 1, 0, 0, 0, 0, 1)).forecast(3) == pytest.approx([y[-1]] * 3)
    assert Fit(y, Order(0, 0, 0, 0, 1, 0, 7)).forecast(7) == pytest.approx(y[-7:])


def test_search_prefers_the_season_and_keeps_shapes():
    t = np.arange(200)
    y = 50 + 10 * (t % 7) + np.random.default_rng(8).normal(0, 0.5, 200)
    found = search.search(y, 0, 1, 7, 14, 21, most=(1, 1, 1, 1), most_rounds=3)
    assert found.cost < 5 and len(found.fitted) == 200 and len(found.forecast) == 21 and len(found.valicast) == 14
    assert np.abs(found.forecast[:7] - (50 + 10 * ((t[-1] + 1 + np.arange(7)) % 7))).max() < 3


def test_search_rejects_wrong_arguments():
    with pytest.raises(ValueError):
        search.search(np.arange(50.0), 0, 0, 1, 10, 5, cost="aic")


def test_series_without_a_stationary_form_is_null(spark):
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=k), float(k)) for k in range(30)]
    panel = spark.createDataFrame(rows, "ts_id string, time_d date, x double")
    params = spark.createDataFrame([("a", False, None, None, None, 7)], "ts_id string, found_stn boolean, func string, d int, seasonal_d int, S int")
    got = grouped.fit_panel(panel, params, "x", 5, 10).collect()
    assert len(got) == 45 and all(r["pred"] is None and r["p"] is None for r in got)


def test_registered_fits_search_the_full_bounds(monkeypatch):
    import inspect

    from tessera.operators import stationarity
    from tessera.plans import forecasts

    real, calls = grouped.fit_panel, []
    monkeypatch.setattr(stationarity, "search_with_log", lambda panel, value: None)
    monkeypatch.setattr(grouped, "fit_panel", lambda *a, **k: calls.append((a, k)))
    forecasts._fitted(None, "", None)
    bound = inspect.signature(real).bind(*calls[0][0], **calls[0][1])
    bound.apply_defaults()
    assert bound.arguments["most"] == (5, 5, 2, 2) and bound.arguments["most_rounds"] >= 1000


def test_inverse_filter_equals_the_recursion():
    rng = np.random.default_rng(1)
    for theta in ([1.0], [1, 0.5], [1, -0.3, 0.2], np.r_[1, np.zeros(6), 0.4], np.r_[1, np.zeros(69), 0.3]):
        theta, a = np.array(theta, float), rng.normal(size=(333, 3))
        want = np.zeros_like(a)
        for t in range(len(a)):
            want[t] = a[t] - sum(theta[j] * want[t - j] for j in range(1, min(t, len(theta) - 1) + 1))
        assert np.abs(Inverse(theta)(a) - want).max() < 1e-9 and np.abs(Inverse(theta)(a[:, 1]) - want[:, 1]).max() < 1e-9


@pytest.mark.parametrize("order", [Order(2, 0, 2, 1, 0, 1, 7), Order(1, 0, 3, 2, 0, 2, 7), Order(0, 1, 0, 0, 1, 1, 7), Order(3, 0, 0, 0, 0, 0, 1)])
def test_jacobian_equals_differences(order):
    rng = np.random.default_rng(4)
    y = 50 + 10 * (np.arange(300) % 7) + rng.normal(size=300)
    fit = Fit(y, order)
    x = 0.9 * fit.params
    e, h = fit._residuals(x), 1e-6
    want = np.column_stack([(fit._residuals(x + h * np.eye(len(x))[k]) - e) / h for k in range(len(x))])
    assert np.abs(fit._jacobian(x, e) - want).max() < 1e-4 * np.abs(want).max()


def test_starts_without_a_constant_follow_where_none_with_one_fits(monkeypatch):
    real = search.Fit

    def picky(y, order, **more):
        if order.const:
            raise ValueError("no constant here")
        return real(y, order, **more)

    monkeypatch.setattr(search, "Fit", picky)
    y = np.random.default_rng(2).normal(size=150)
    found = search.search(y, 0, 0, 1, 10, 5)
    assert found.order is not None and not found.order.const and np.isfinite(found.forecast).all()


def test_aic_finds_the_order_of_an_autoregression():
    rng = np.random.default_rng(9)
    y = np.zeros(800)
    for t in range(2, 800):
        y[t] = 0.5 * y[t - 1] + 0.3 * y[t - 2] + rng.normal()
    found = search.search(y, 0, 0, 1, 0, 5, cost="aic")
    assert found.order.p + found.order.q >= 2 and len(found.valicast) == 0
    whole = [search.Fit(y, o).aic for o in (Order(0, 0, 0, 0, 0, 0, 1), Order(1, 0, 0, 0, 0, 0, 1), found.order)]
    assert whole[2] == pytest.approx(found.cost) and whole[2] < min(whole[:2])


def variables(spark, days, start=dt.date(2024, 1, 1)):
    rng = np.random.default_rng(3)
    rows = [("a", "x", start + dt.timedelta(days=k), float(10 + k % 7 + rng.normal())) for k in range(days)]
    rows += [("a", "w", start + dt.timedelta(days=7 * k), float(5 + rng.normal())) for k in range(days // 7)]
    stacked = spark.createDataFrame(rows, "ts_id string, variable string, time_d date, y double")
    params = spark.createDataFrame([("a", "x", True, "asis", 0, 0, 7), ("a", "w", True, "asis", 0, 0, 1)], "ts_id string, variable string, found_stn boolean, func string, d int, seasonal_d int, S int")
    return stacked, params


def test_every_variable_has_its_own_horizon_and_step(spark):
    got = grouped.fit_variables(*variables(spark, 140), {"x": (14, 21, 1), "w": (3, 4, 7)}).collect()
    n = lambda v, s: sorted(r["time_d"] for r in got if (r["variable"], r["sample"]) == (v, s))
    assert [len(n("x", s)) for s in ("fitted", "valicast", "forecast")] == [140, 14, 21]
    assert [len(n("w", s)) for s in ("fitted", "valicast", "forecast")] == [20, 3, 4]
    assert n("w", "forecast")[1] - n("w", "forecast")[0] == dt.timedelta(days=7) and n("x", "forecast")[0] == n("x", "fitted")[-1] + dt.timedelta(days=1)
    assert grouped.specification(spark.createDataFrame(got, grouped.SCHEMA)).count() == 2


def test_short_series_and_gaps_are_null_with_a_reason(spark):
    stacked, params = variables(spark, 10)
    got = grouped.fit_variables(stacked, params, {"x": (14, 5, 1), "w": (3, 4, 7)}).where("variable = 'x'").collect()
    assert len(got) == 10 + 10 + 5 and all(r["pred"] is None and r["failure"] == "too short" for r in got)
    holed = grouped.fit_variables(stacked.where("time_d <> date'2024-01-04'"), params, {"x": (3, 5, 1), "w": (3, 4, 7)}).where("variable = 'x'").collect()
    assert len(holed) == 9 + 3 + 5 and all(r["pred"] is None and r["failure"] == "gap" for r in holed)


def many(spark, n, days=40, empty=()):
    """n series of one variable; those in `empty` have no values, or a hole, or no parameters."""
    rng = np.random.default_rng(5)
    start = dt.date(2024, 1, 1)
    rows = []
    for k in range(n):
        for t in range(days):
            y = float(10 + t % 7 + rng.normal())
            if k in empty:
                y = None if k % 3 == 0 or (k % 3 == 1 and t == 20) else y
            rows.append((f"s{k:03d}", "x", start + dt.timedelta(days=t), y))
    params = [(f"s{k:03d}", "x", True, "asis", 0, 0, 7) for k in range(n) if not (k in empty and k % 3 == 2)]
    stacked = spark.createDataFrame(rows, "ts_id string, variable string, time_d date, y double")
    return stacked, spark.createDataFrame(params, "ts_id string, variable string, found_stn boolean, func string, d int, seasonal_d int, S int")


SMALL = {"most": (1, 1, 0, 0), "most_rounds": 2}


def test_failures_stay_with_their_series(spark, monkeypatch):
    stacked, params = many(spark, 6, empty={0, 1, 2})
    got = grouped.fit_variables(stacked, params, {"x": (5, 4, 1)}, **SMALL).collect()
    assert {r["ts_id"]: r["failure"] for r in got} == {"s000": "no values", "s001": "gap", "s002": "no stationary form", "s003": None, "s004": None, "s005": None}
    assert all(sum(r["ts_id"] == f"s{k:03d}" for r in got) == 40 + 5 + 4 for k in range(6))
    assert all((r["pred"] is None) == (r["failure"] is not None) for r in got if r["sample"] == "valicast")
    row = next(stacked.join(params, ["ts_id", "variable"]).limit(1).toLocalIterator())
    broken = type("Row", (), {"ts_id": "z", "variable": "x", "days": [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(40)], "ys": list(range(40)), "found_stn": True, "func": "asis", "d": 0, "seasonal_d": 0, "S": 7})
    monkeypatch.setattr(grouped, "search", lambda *a, **k: np.linalg.inv(np.zeros((2, 2))))
    out = grouped.fit_row(broken, 5, 4, 1, (1, 1, 0, 0), 2)
    assert row is not None and len(out) == 49 and out["pred"].isna().all() and out["failure"].str.startswith("numeric: LinAlgError").all()


def test_six_series_use_six_tasks(spark):
    stacked, params = many(spark, 6)
    rows, tasks = grouped.planned(stacked, params, tasks=8)
    fitted = grouped.fit_planned(rows, tasks, {"x": (5, 4, 1)}, **SMALL)
    used = fitted.select(F.spark_partition_id().alias("p"), "ts_id").distinct().groupBy("p").count().collect()
    assert tasks == 6 == len(used)


def test_fits_of_four_kinds_are_level(spark):
    """192 fits, half of them dear: no task has over 1.3 times the mean cost, and every task works."""
    rows = [(f"s{k}", v, c) for k in range(48) for v, c in (("dl", 0.55), ("dw", 0.54), ("wl", 0.12), ("ww", 0.1 + k / 5000))]
    df = spark.createDataFrame(rows, "ts_id string, variable string, cost double")
    loads = packing.packed(df, 16)[0].groupBy("task").agg(F.sum("cost").alias("c"), F.count("*").alias("n")).collect()
    assert len(loads) == 16 and sum(r["n"] for r in loads) == 192
    costs = [r["c"] for r in loads]
    assert max(costs) <= 1.1 * sum(costs) / 16


def test_one_dear_fit_gets_a_task_to_itself():
    given = packing.deal([(100.0, 1), (1.0, 900)], 10)
    loads = given[0] * 100 + given[1]
    assert loads.max() == 100 and sum(given[1]) == 900
    assert packing.deal([(1.0, 3)], 5)[0].tolist().count(1) == 3
    rng = np.random.default_rng(1)
    classes = sorted(((float(c), int(n)) for c, n in zip(rng.lognormal(0, 1.5, 60), rng.integers(1, 80, 60), strict=True)), reverse=True)
    given = packing.deal(classes, 24)
    assert [int(g.sum()) for g in given] == [n for _, n in classes] and all((g >= 0).all() for g in given)
    loads = sum(g * c for g, (c, _) in zip(given, classes, strict=True))
    assert loads.max() <= max(1.1 * loads.mean(), classes[0][0])


def test_a_broken_job_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    stacked, params = many(spark, 12, empty={0, 1})
    horizons, folder = {"x": (5, 4, 1)}, f"file://{tmp_path}/fits"
    real, calls = ledger.Ledger.commit, []

    def breaking(self, chunk, fitted, series):
        calls.append(chunk)
        if len(calls) == 3:
            fitted.limit(7).write.parquet(f"{folder}/attempts/broken")
            fitted.limit(7).write.parquet(f"{folder}/fits/chunk={chunk}")  # moved, never entered
            raise RuntimeError("killed")
        return real(self, chunk, fitted, series)

    monkeypatch.setattr(ledger.Ledger, "commit", breaking)
    with pytest.raises(RuntimeError, match="killed"):
        ledger.fit_resumed(stacked, params, horizons, folder, chunks=4, tasks=2, **SMALL)
    left = ledger.Ledger(spark, folder)
    assert len(left.done()) == 2 and left.fits().select("ts_id").distinct().count() == left.series().where(F.col("chunk").isin(left.done())).count()
    monkeypatch.setattr(ledger.Ledger, "commit", lambda self, k, f, n: calls.append(("again", k)) or real(self, k, f, n))
    whole = ledger.fit_resumed(stacked, params, horizons, folder, chunks=4, tasks=2, **SMALL)
    assert sorted(c[1] for c in calls[3:]) == sorted(set(left.chunks()) - set(calls[:2]))
    rows = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert rows(whole) == rows(grouped.fit_variables(stacked, params, horizons, **SMALL))
    # a retried write adds nothing, a chunk with missing series isn't entered
    assert not real(left, calls[0], whole, 3) and rows(left.fits()) == rows(whole)
    assert left.run(horizons, **SMALL) == []
    with pytest.raises(ValueError, match="other series"):
        ledger.fit_resumed(stacked.where("ts_id <> 's003'"), params, horizons, folder, chunks=4, **SMALL)


def test_a_chunk_that_lost_series_is_not_entered(spark, tmp_path):
    stacked, params = many(spark, 4)
    book = ledger.Ledger(spark, f"file://{tmp_path}/fits")
    book.open(stacked, params, 2, tasks=2)
    rows = book.series().where("chunk = 0")
    short = grouped.fit_planned(rows.limit(1), 1, {"x": (5, 4, 1)}, **SMALL)
    with pytest.raises(RuntimeError, match="series"):
        book.commit(0, short, rows.count() + 1)
    assert book.done() == []
