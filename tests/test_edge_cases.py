import datetime as dt
import math

import pytest
from pyspark.sql import Row, functions as F

from tessera.functions import calendar, numeric
from tessera.operators import backtransform, clean, ensembles, holidays, panel, report, stationarity, stats, submission, topline, transform

START = dt.date(2024, 1, 1)


def series(spark, values, ts_id="a", **more):
    rows = [(ts_id, START + dt.timedelta(days=k), None if v is None else float(v), *more.values()) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "ts_id string, time_d date, daily_untouched double" + "".join(f", {k} string" for k in more))


def cleaned(spark, values):
    return [(r["missing_type"], r["daily_cleaned"]) for r in clean.daily_clean(series(spark, values)).orderBy("time_d").collect()]


def test_leading_gap_stays(spark):
    got = cleaned(spark, [None] * 10 + [5] * 20)
    assert all(x == ("missing_short", None) for x in got[:10]) and all(x == ("no_missing", 5.0) for x in got[10:])


def test_hole_takes_the_mean_of_its_weekday(spark):
    values = [float(k % 7) for k in range(40)]
    values[20] = None
    assert cleaned(spark, values)[20] == ("missing_hole", (values[13] + values[27]) / 2)


def test_hole_near_the_start_takes_the_rolling_mean(spark):
    got = cleaned(spark, [4, 4, None, 4, 4])
    assert got[2] == ("missing_hole", 4.0)


def test_wide_hole_is_filled_forward(spark):
    got = cleaned(spark, [7] * 10 + [None] * 40 + [7] * 10)
    assert all(v == 7.0 for _, v in got)


def test_all_missing(spark):
    assert cleaned(spark, [None] * 30) == [("missing_short", None)] * 30
    found = stationarity.search(series(spark, [None] * 30), "daily_untouched").first()
    assert not found["found_stn"] and found["d"] is None
    total = stats.summary(series(spark, [None] * 30).withColumnRenamed("daily_untouched", "daily_level")).first()
    assert total["sum"] == 0.0 and total["mean"] is None and total["median60"] is None


def test_negative_becomes_zero(spark):
    assert cleaned(spark, [-3, -3, -3])[0] == ("no_missing", 0.0)


def test_constant_is_not_stationary_white_noise_is(spark):
    import random

    rng = random.Random(1)
    assert not stationarity.search(series(spark, [5] * 100), "daily_untouched").first()["found_stn"]
    noise = [rng.gauss(0, 1) for _ in range(300)]
    walk = [sum(noise[: k + 1]) for k in range(300)]
    assert stationarity.search(series(spark, noise), "daily_untouched").first()["d"] == 0
    assert stationarity.search(series(spark, walk), "daily_untouched").first()["d"] == 1


def test_kpss_against_numpy(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=150).cumsum()
    e, n = x - x.mean(), len(x)
    lags = math.ceil(12 * (n / 100) ** 0.25)
    s2 = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / n
    want = (e.cumsum() ** 2).sum() / n**2 / s2
    got = stationarity.attempts(series(spark, x.tolist()), "daily_untouched", 7).where("attempt = 0").first()["stat"]
    assert got == pytest.approx(want, rel=1e-9)


def test_zero_counts_as_one_in_growth(spark):
    df = transform.growth(series(spark, [0] * 7 + [7]), "daily_untouched", "g", 7)
    assert df.orderBy("time_d").collect()[7]["g"] == 6.0


def test_weeks(spark):
    days = spark.createDataFrame([(START + dt.timedelta(days=k),) for k in range(10)], "d date")
    got = days.select(calendar.week_ending(F.col("d")), calendar.first_monday(F.col("d")), calendar.last_sunday(F.col("d"))).collect()
    assert got[6][0] == dt.date(2024, 1, 7) and got[0][1] == START and got[1][1] == dt.date(2024, 1, 8) and got[6][2] == dt.date(2024, 1, 7)


def test_missing_week_sums_to_zero(spark):
    assert [r["w"] for r in transform.weekly(series(spark, [None] * 7 + [1] * 7), {"daily_untouched": "w"}).orderBy("time_w").collect()] == [0.0, 7.0]


@pytest.mark.parametrize(("rows", "want"), [([(0.0, 0.0), (1.0, None), (1.0, 3.0)], 50.0), ([(None, 1.0)], None), ([(None, 0.0), (2.0, 2.0)], 0.0)])
def test_smape(spark, rows, want):
    df = spark.createDataFrame(rows, "f double, a double")
    assert df.agg(numeric.smape(F.col("f"), F.col("a"))).first()[0] == want


def test_row_statistics_skip_missing(spark):
    row = spark.createDataFrame([(1.0, None, 4.0)], "a double, b double, c double")
    cols = [F.col(c) for c in "abc"]
    assert tuple(row.select(numeric.row_mean(cols), numeric.row_median(cols), numeric.least_or_null(F.col("b"), F.lit(10.0)), numeric.finite_or_zero(F.col("b"))).first()) == (2.5, 2.5, None, 0.0)


def test_ranks_and_weights(spark):
    losses = spark.createDataFrame([("a", "m2", 3.0), ("a", "m1", 3.0), ("a", "m3", None), ("b", "m1", None), ("b", "m2", None), ("b", "m3", None)], "ts_id string, model string, loss double")
    rank = {(r["ts_id"], r["model"]): r["model_rank"] for r in ensembles.ranks(losses).collect()}
    assert [rank["a", m] for m in ("m1", "m2", "m3")] == [1, 2, 3]
    weight = {(r["ts_id"], r["model"]): r["weight"] for r in ensembles.weights(losses, 1).collect()}
    assert weight["a", "m1"] == 1.0 and weight["a", "m2"] == 0.0 and weight["b", "m3"] == pytest.approx(1 / 3)


def test_blend_is_not_renormalised(spark):
    models = spark.createDataFrame([("a", None, 4.0)], "ts_id string, m1 double, m2 double")
    wide = spark.createDataFrame([("a", 0.5, 0.5)], "ts_id string, reWt_m1 double, reWt_m2 double")
    assert ensembles.blend(models, wide, ["m1", "m2"], "x").first()["x"] == 2.0


def test_functionwise_median_of_an_odd_number(spark):
    models = spark.createDataFrame([("a", 1.0, 9.0, 5.0)], "ts_id string, m1 double, m2 double, m3 double")
    assert ensembles.functionwise(models, ["m1", "m2", "m3"]).first()["ensmod_funcwise_median"] == 5.0


def test_intraweek_of_nothing_is_uniform(spark):
    df = spark.createDataFrame([("a", k, 0.0) for k in range(7)], "ts_id string, day_of_week int, trunc60_sum60 double")
    assert all(r["share"] == pytest.approx(1 / 7) for r in stats.intraweek(df).collect())


def test_growth_there_and_back(spark):
    full = transform.daily_growth(series(spark, [float(3 + k * k % 11) for k in range(60)]).withColumn("daily_level", F.col("daily_untouched")))
    last = report.last_days(full, 21)
    got = backtransform.daily_growth_to_level(last, full).collect()
    assert len(got) == 21 and all(r["daily_wowGr_predbt"] == pytest.approx(r["daily_level"]) for r in got)


def test_missing_growth_breaks_the_product(spark):
    full = transform.daily_growth(series(spark, [float(k + 1) for k in range(40)]).withColumn("daily_level", F.col("daily_untouched")))
    last = report.last_days(full, 21).withColumn("daily_wowGr", F.when(F.col("time_d") != START + dt.timedelta(days=26), F.col("daily_wowGr")))
    got = {r["time_d"]: r["daily_wowGr_predbt"] for r in backtransform.daily_growth_to_level(last, full).collect()}
    assert got[START + dt.timedelta(days=19)] is not None and got[START + dt.timedelta(days=26)] is None and got[START + dt.timedelta(days=33)] is None


def test_holiday_of_one_year(spark):
    values = [10.0] * 370
    values[358] = 500.0  # 2024-12-24 is day 358, 25th is 359
    values[359] = 500.0
    df = clean.daily_clean(series(spark, values, project="en"))
    table = holidays.holiday_table(spark)
    label = {r["time_d"]: r["holiday"] for r in holidays.flags(df, table).collect()}
    assert label[dt.date(2024, 12, 25)] == "christmas_adj" and label[dt.date(2024, 10, 31)] == "halloween_noadj" and label[dt.date(2024, 11, 1)] == "regular_day"
    factor = {r["holiday"]: r["adjustment_factor"] for r in holidays.factors(df, table).collect()}
    assert set(factor) == {"christmas"} and factor["christmas"] > 10


def test_holiday_outside_the_calendar_has_a_null_factor(spark):
    df = clean.daily_clean(series(spark, [1, 2, 3, 4, 5], project="en"))
    got = {r["holiday"]: r["adjustment_factor"] for r in holidays.factors(df, holidays.holiday_table(spark)).collect()}
    assert got == {"halloween": None, "christmas": None}


def test_short_series_scale_the_topline(spark):
    both = series(spark, [2, 2], "a").union(series(spark, [None, 4], "b")).withColumns({"grp": F.lit("g"), "daily_level": F.col("daily_untouched")})
    got = topline.daily(both.withColumn("missing_type", clean.missing_type())).orderBy("time_d").collect()
    assert got[0]["shrtAdj_factor"] == 3.0 and got[0]["daily_level_shrtAdj"] == 6.0 and got[1]["shrtAdj_factor"] == 1.0


def test_series_ids_are_in_key_order(spark):
    rows = spark.createDataFrame([(f"k{k % 23:02d}",) for k in range(200)], "k string")
    got = panel.series_ids(rows, ["k"]).orderBy("ts_id").collect()
    assert [(r["ts_id"], r["k"]) for r in got] == [(k, f"k{k:02d}") for k in range(23)]


def test_dated_key(spark):
    row = submission.parse_dated_key(spark.createDataFrame([Row(Page="A_b_c_en.x.org_all_spider_2017-09-10")])).first()
    assert (row["name"], row["project"], row["access"], row["agent"], row["time_d"]) == ("A_b_c", "en.x.org", "all", "spider", dt.date(2017, 9, 10))


def test_dense_fills_between_before_and_after(spark):
    day = lambda k: START + dt.timedelta(days=k)
    sparse = spark.createDataFrame([("a", day(2), 1.0), ("a", day(5), 2.0), ("b", day(0), 3.0), ("c", day(6), None)], "ts_id string, time_d date, x double")
    got = {(r["ts_id"], (r["time_d"] - START).days): r["x"] for r in panel.dense(sparse, "x").collect()}
    assert len(got) == 21 and {k: v for k, v in got.items() if v is not None} == {("a", 2): 1.0, ("a", 5): 2.0, ("b", 0): 3.0}
    assert panel.dense(sparse.limit(0), "x").count() == 0


def test_series_ids_have_no_gaps_over_many_ranges(spark):
    keys = spark.range(5000).select((F.col("id") * 7 % 5000).alias("k"), F.lit("x").alias("z"))
    got = panel.series_ids(keys.union(keys), ["k", "z"]).orderBy("ts_id").collect()
    assert [r["ts_id"] for r in got] == list(range(5000)) == [r["k"] for r in got]


def test_weekly_growth_from_fitted_weeks(spark):
    rows = [("a", START + dt.timedelta(days=6 + 7 * k), level, growth) for k, (level, growth) in enumerate([(10.0, None), (99.0, 0.5), (99.0, 1.0), (99.0, None), (99.0, 1.0)])]
    df = spark.createDataFrame(rows, "ts_id string, time_w date, weekly_level double, weekly_wowGr double")
    got = [r["weekly_wowGr_predbt"] for r in backtransform.fitted_weekly_growth_to_level(df).orderBy("time_w").collect()]
    assert got == [None, 15.0, 30.0, None, None]


def test_key_rows_without_a_series_are_an_error(spark):
    pages = spark.createDataFrame([(0, "n", "p", "a", "g")], "ts_id long, name string, project string, access string, agent string")
    keys = submission.parse_dated_key(spark.createDataFrame([("n_p_a_g_2024-01-01", "i1")], "Page string, Id string"))
    assert [r["ts_id"] for r in submission.with_series(keys, pages).collect()] == [0]
    lost = submission.parse_dated_key(spark.createDataFrame([("n_p_a_x_2024-01-01", "i2")], "Page string, Id string"))
    with pytest.raises(Exception, match="no series for page n_p_a_x"):
        submission.with_series(lost, pages).collect()


def test_stationary_series_takes_logarithm_and_differences(spark):
    df = series(spark, [1, 2, 4, 8, 0])
    params = spark.createDataFrame([("a", True, "log", 1, 0, 7)], "ts_id string, found_stn boolean, func string, d int, seasonal_d int, S int")
    got = [r["stn"] for r in stationarity.stationary_series(df, params, "daily_untouched").orderBy("time_d").collect()]
    assert got[0] is None and got[1:] == pytest.approx([math.log(2)] * 3 + [-math.log(8)])


def test_series_of_another_length_are_found(spark):
    both = series(spark, [1, 2, 3]).union(series(spark, [1, 2], "b"))
    assert [r["ts_id"] for r in ensembles.lengths_check(both).collect()] == ["b"]


def test_top_pages_filters_by_the_map(spark):
    from tessera.operators import report

    pages = [(0, "A", "en", "all", "all"), (1, "Special:B", "en", "all", "all"), (2, "Xenon", "en", "all", "all"), (3, "C", "fr", "all", "all"), (4, "D", "en", "all", "all"), (5, "E", "en", "desktop", "all"), (6, "F", "en", "all", "all")]
    page_map = spark.createDataFrame(pages, "ts_id long, name string, project string, access string, agent string")
    visits = spark.createDataFrame([(k, float(10 - k)) for k in range(7)] + [(4, 5.0), (6, None), (0, None)], "ts_id long, v double")
    got = report.top_pages(visits, page_map, "v", 2, {"project": "en", "access": "all", "agent": "all"}, ("Special:",), ("X",)).collect()
    assert [(r["ts_id"], r["total"], r["name"]) for r in got] == [(4, 11.0, "D"), (0, 10.0, "A")]
