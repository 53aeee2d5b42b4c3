"""The fitted path on a small panel with a series without values, one with a gap, and a holiday."""

import datetime as dt
from statistics import mean

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import clean
from tessera.plans import fitted
from tessera.plans.forecasts import ENSEMBLES, MODELS
from tessera.plans.scope import scoped
from tessera.sarima import grouped
from tessera.storage import CheckFailed, materialize

START, DAYS = dt.date(2023, 5, 8), 252  # Monday to Sunday 2024-01-14; the last 60 days hold Christmas
CHRISTMAS = dt.date(2023, 12, 25)


@pytest.fixture(scope="module")
def out(spark):
    rng, rows = np.random.default_rng(11), []
    for name in ("a", "b", "c", "empty", "gap"):
        for t in range(DAYS):
            day, y = START + dt.timedelta(days=t), float(50 + 10 * (t % 7) + rng.normal())
            if name == "a" and day == CHRISTMAS:
                y += 400
            rows.append((name, "g", day, None if name == "empty" else y))
    panel = spark.createDataFrame(rows, "ts_id string, grp string, time_d date, daily_untouched double")
    levels = clean.daily_clean(panel).withColumns({"daily_level": F.col("daily_cleaned"), "day_of_week": F.weekday("time_d")})
    hole = (F.col("ts_id") == "gap") & (F.col("time_d") == F.lit(START + dt.timedelta(days=100)))
    levels = levels.withColumn("daily_level", F.when(~hole, F.col("daily_level")))
    levels, _ = materialize(levels, "test-levels")

    patch = pytest.MonkeyPatch()
    patch.setattr(fitted, "kept_levels", lambda spark, sf: levels)
    fits = lambda spark, sf: fitted.once("fits", lambda: grouped.fit_variables(fitted.stacked(spark, sf), fitted.parameters(spark, sf), fitted.HORIZONS, most=(1, 1, 0, 0), most_rounds=2))
    patch.setattr(fitted, "fits", fits)
    found = {}

    def run(spark, sf):
        found["failures"] = fitted.fits(spark, sf).select("ts_id", "variable", "failure").distinct().collect()
        found["matrix"] = fitted.matrix(spark, sf, "valicast").collect()
        found["validation"] = fitted.validation(spark, sf).collect()
        found["factors"] = fitted.holiday_factors(spark, sf).collect()
        found["scores"] = fitted.pipeline_scores(spark, sf).collect()
        found["plugged"] = fitted.plugged_scores(spark, sf).collect()
        scores = fitted.ensembles.losses(fitted.blended(spark, sf, fitted.validation(spark, sf)), "daily_untouched", MODELS, ("ts_id",))
        found["plan"] = scores._jdf.queryExecution().executedPlan().toString()
        found["forecast"] = fitted.pipeline_end_to_end(spark, sf).collect()
        return found["scores"]

    scoped(run)(spark, "")
    patch.undo()
    return found


def test_failures_are_kept_by_variable(out):
    why = {(r["ts_id"], r["variable"]): r["failure"] for r in out["failures"]}
    assert len(why) == 6 * 4
    assert why["empty|series", "daily_level"] == why["empty|series", "daily_wowGr"] == "no values"
    assert why["gap|series", "daily_level"] == "gap"
    assert all(v is None for (k, name), v in why.items() if k in ("b|series", "c|series") and name == "daily_level")


def test_every_series_reaches_the_last_table(out):
    keys = {(r["ts_id"], r["time_d"]) for r in out["forecast"]}
    assert len(out["forecast"]) == len(keys) == 5 * 60 and {k for k, _ in keys} == {"a", "b", "c", "empty", "gap"}
    empty = [r for r in out["forecast"] if r["ts_id"] == "empty"]
    assert all(r["mod_ts_daily_level"] is None and r["mod_ts_daily_wowGr"] is None for r in empty)
    assert min(k[1] for k in keys) == START + dt.timedelta(days=DAYS)


def test_ensembles_are_over_what_is_there(out):
    """One model of the series with a gap is all NULL: ensembles, ranks and blends go without it, nothing is plugged."""
    factor = out["factors"]
    assert [(r["ts_id"], r["holiday"]) for r in factor if r["adjustment_factor"] is not None and r["holiday"] == "christmas" and r["ts_id"] == "a"]
    rows = {(r["ts_id"], r["time_d"]): r for r in out["validation"]}
    raw = {(r["ts_id"], r["time_d"]): r for r in out["matrix"]}
    gap = [(k, r) for k, r in rows.items() if k[0] == "gap"]
    assert len(gap) == 60 and all(r["mod_ts_daily_level"] is None for _, r in gap)
    for k, r in gap:
        there = [raw[k][m] for m in MODELS if raw[k][m] is not None]
        if k[1] != CHRISTMAS:
            assert 0 < len(there) < 12 and r["ensmod_pointwise_mean"] == pytest.approx(mean(there))


def test_holidays_come_back_on_their_day(out):
    factor = next(r["adjustment_factor"] for r in out["factors"] if r["ts_id"] == "a" and r["holiday"] == "christmas")
    assert factor > 3
    rows, raw = ({(r["ts_id"], r["time_d"]): r for r in out[n]} for n in ("validation", "matrix"))
    for day, times in ((CHRISTMAS, factor), (CHRISTMAS - dt.timedelta(days=1), 1.0)):
        there = [raw["a", day][m] for m in MODELS if raw["a", day][m] is not None]
        assert rows["a", day]["ensmod_pointwise_mean"] == pytest.approx(times * mean(there))
        assert all(rows["a", day][m] == pytest.approx(times * raw["a", day][m]) for m in MODELS if raw["a", day][m] is not None)


def test_scores_with_and_without_plugs(out):
    scores, plugged = ({r["model"]: r["loss"] for r in out[n]} for n in ("scores", "plugged"))
    assert set(scores) == {*MODELS, *ENSEMBLES, *fitted.BLENDS} and set(plugged) == {*MODELS, *ENSEMBLES}
    assert scores["mod_sstat_median_last60"] == plugged["mod_sstat_median_last60"]
    assert scores["mod_ts_daily_level"] != plugged["mod_ts_daily_level"]


def test_matrix_losses_and_blends_join_in_their_buckets(out):
    """Behind the levels nothing is shuffled by series: validation, losses, weights and blends are in the same buckets."""
    assert "hashpartitioning(ts_id" not in out["plan"] and "Join" in out["plan"]


def test_a_day_without_its_actual_value_stops_the_pipeline(spark):
    frame = spark.createDataFrame([("a", None)], "ts_id string, actual boolean")
    with pytest.raises(CheckFailed, match="actual complete"):
        fitted.once("validation", lambda: frame, fitted.checks.complete("actual"), by="ts_id")
