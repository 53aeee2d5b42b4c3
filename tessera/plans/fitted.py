"""The forecast path on fitted models: four variables of every series and topline, three samples, components, ensembles, blends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import backtransform, checks, components, ensembles, holidays, report, stationarity, stats, topline, transform
from ..sarima import grouped, ledger
from ..storage import fresh_path, temporary
from .basics import query, r, rounded
from .forecasts import ENSEMBLES, MODELS, kept_levels
from .panels import HORIZON
from .scope import once

#: Variable -> values held for validation, forecast steps, days a step.
HORIZONS = {"daily_level": (60, 70, 1), "daily_wowGr": (60, 70, 1), "weekly_level": (10, 12, 7), "weekly_wowGr": (10, 12, 7)}
SEASONS = {"daily_level": 7, "daily_wowGr": 7, "weekly_level": 1, "weekly_wowGr": 1}
#: Marks of a series' and of a topline's key, behind it.
SERIES, TOPLINE = "|series", "|topline"
BLENDS = {"postValiMod_ens_ranked1": 1, "postValiMod_ens_ranked5": 5}


def history(spark: SparkSession, sf: str) -> DataFrame:
    """ts_id, time_d, daily_level, daily_wowGr, day_of_week of all series of panel pe and of their toplines."""

    def make() -> DataFrame:
        lv = kept_levels(spark, sf)
        own = lv.select(F.concat("ts_id", F.lit(SERIES)).alias("ts_id"), "time_d", "daily_level")
        top = topline.daily(lv).select(F.concat("grp", F.lit(TOPLINE)).alias("ts_id"), "time_d", F.col("daily_level_shrtAdj").alias("daily_level"))
        return transform.daily_growth(own.unionByName(top))

    return once("history", make)


def weeks(spark: SparkSession, sf: str) -> DataFrame:
    return once("weeks", lambda: transform.weekly_growth(transform.weekly(history(spark, sf), {"daily_level": "weekly_level"})))


def stacked(spark: SparkSession, sf: str) -> DataFrame:
    """ts_id, variable, time_d, y of the four variables; a series without values keeps its days."""

    def make() -> DataFrame:
        parts = []
        for df, time, names in ((history(spark, sf), "time_d", ("daily_level", "daily_wowGr")), (weeks(spark, sf), "time_w", ("weekly_level", "weekly_wowGr"))):
            parts += [df.select("ts_id", F.lit(v).alias("variable"), F.col(time).alias("time_d"), F.col(v).alias("y")) for v in names]
        return reduce(DataFrame.unionByName, parts)

    return once("stacked", make)


def parameters(spark: SparkSession, sf: str) -> DataFrame:
    """The stationarity search of every series and variable: ts_id, variable, found_stn, func, d, seasonal_d, S."""

    def make() -> DataFrame:
        keyed = stacked(spark, sf).where("y is not null").withColumn("key", F.concat_ws("|", "ts_id", "variable"))
        out = []
        for season in (7, 1):
            names = [v for v, s in SEASONS.items() if s == season]
            found = stationarity.search_with_log(keyed.where(F.col("variable").isin(names)).select(F.col("key").alias("ts_id"), "time_d", "y"), "y", season)
            out.append(found.select(F.regexp_extract("ts_id", r"^(.*)\|[^|]*$", 1).alias("ts_id"), F.substring_index("ts_id", "|", -1).alias("variable"), "found_stn", "func", "d", "seasonal_d", "S"))
        return reduce(DataFrame.unionByName, out)

    return once("parameters", make)


def fits(spark: SparkSession, sf: str) -> DataFrame:
    return once("fits", lambda: grouped.fit_variables(stacked(spark, sf), parameters(spark, sf), HORIZONS))


def _wide(fitted: DataFrame, sample: str, names: tuple[str, str], time: str) -> DataFrame:
    own = fitted.where((F.col("sample") == sample) & F.col("variable").isin(*names))
    return own.groupBy("ts_id", F.col("time_d").alias(time)).agg(*[F.max(F.when(F.col("variable") == v, F.col("pred"))).alias(v) for v in names])


def levels_back(spark: SparkSession, sf: str) -> DataFrame:
    """sample, ts_id, time_d and the four predictions as daily levels, of every series and topline.

    Weekly values are dealt by the shares of the days of the week in the 60 days before the validation; in the fitted sample a
    growth starts from the first fitted values, in the others from the last actual ones before the sample.
    """

    def make() -> DataFrame:
        past, by_week, found = history(spark, sf), weeks(spark, sf), fits(spark, sf)
        share = once("week-shares", lambda: stats.intraweek(stats.summary(past, ("ts_id", "day_of_week"))))
        out = []
        for sample in ("fitted", "valicast", "forecast"):
            daily, weekly = _wide(found, sample, ("daily_level", "daily_wowGr"), "time_d"), _wide(found, sample, ("weekly_level", "weekly_wowGr"), "time_w")
            if sample == "fitted":
                back = backtransform.back_transform_fitted(daily, weekly, share)
            else:
                back = backtransform.back_transform(daily, weekly, past, by_week, share)
            out.append(back.select(F.lit(sample).alias("sample"), "ts_id", "time_d", *[f"{v}_predbt" for v in HORIZONS]))
        return reduce(DataFrame.unionByName, out)

    return once("levels-back", make)


def dealt(spark: SparkSession, sf: str, sample: str) -> DataFrame:
    """The toplines' predictions dealt to the series; in the validation by shares that don't know it, else by the last 60 days."""
    by_group = stats.proportions(stats.summary(kept_levels(spark, sf), ("ts_id", "grp")))
    share = "hist_prop_trunc60_last60days" if sample == "valicast" else "hist_prop_last60days"
    back = levels_back(spark, sf).where(F.col("sample") == sample)
    top = back.where(F.col("ts_id").endswith(TOPLINE)).select(F.expr(f"left(ts_id, length(ts_id) - {len(TOPLINE)})").alias("grp"), "time_d", *[F.col(f"{v}_predbt").alias(f"mod_agg_{v}") for v in HORIZONS])
    return topline.distribute(top, by_group, [f"mod_agg_{v}" for v in HORIZONS], share).drop("grp")


def matrix(spark: SparkSession, sf: str, sample: str) -> DataFrame:
    """ts_id, time_d and the 12 component models of a sample (valicast or forecast) on HORIZON days."""

    def make() -> DataFrame:
        lv = kept_levels(spark, sf)
        back = levels_back(spark, sf).where(F.col("sample") == sample)
        own = back.where(F.col("ts_id").endswith(SERIES)).select(F.expr(f"left(ts_id, length(ts_id) - {len(SERIES)})").alias("ts_id"), "time_d", *[F.col(f"{v}_predbt").alias(f"mod_ts_{v}") for v in HORIZONS])
        first = F.broadcast(own.agg(F.date_add(F.min("time_d"), HORIZON).alias("end")))
        own = own.join(first, F.col("time_d") < F.col("end")).drop("end")
        weekday = stats.summary(lv, ("ts_id", "day_of_week"))
        limit, seasonal = ("trimmax_trunc60", components.SEASONAL_TRUNCATED) if sample == "valicast" else ("trimmax", components.SEASONAL)
        return components.matrix(own, dealt(spark, sf, sample), components.trim_limits(lv), weekday, limit, seasonal)

    return once(f"fitted-matrix-{sample}", make, by="ts_id")


def holiday_factors(spark: SparkSession, sf: str) -> DataFrame:
    """ts_id, holiday, month, day, adjustment_factor of holidays that were outliers in every year."""

    def make() -> DataFrame:
        cleaned = kept_levels(spark, sf).select("ts_id", F.lit("all").alias("project"), "time_d", "outlier", "daily_untouched", "daily_cleaned")
        return holidays.factors(cleaned, holidays.holiday_table(spark))

    return once("holiday-factors", make)


def with_holidays(spark: SparkSession, sf: str, sample: str, models: DataFrame) -> DataFrame:
    """All models with the holidays' factors back on: in the validation on the flagged days, in a forecast on any year's."""
    columns = [*MODELS, *ENSEMBLES]
    if sample != "valicast":
        return holidays.reholiday(models, holiday_factors(spark, sf), models, columns, "month_day")
    past = kept_levels(spark, sf).select("ts_id", F.lit("all").alias("project"), "time_d", "outlier", "daily_untouched", "daily_cleaned")
    return holidays.reholiday(models, holiday_factors(spark, sf), holidays.flags(past, holidays.holiday_table(spark)), columns, "date")


def with_ensembles(spark: SparkSession, sf: str, sample: str) -> DataFrame:
    """The matrix, the three candidate ensembles over the models that aren't missing, and then the holidays."""

    def make() -> DataFrame:
        models = ensembles.functionwise(ensembles.pointwise(matrix(spark, sf, sample), MODELS), MODELS)
        return with_holidays(spark, sf, sample, models)

    return once(f"fitted-ensembles-{sample}", make, by="ts_id")


def validation(spark: SparkSession, sf: str) -> DataFrame:
    """The models with the actual values of their days; that each row of the models finds its day is checked in the same pass."""

    def make() -> DataFrame:
        actual = once("actuals", lambda: report.last_days(kept_levels(spark, sf), HORIZON).select("ts_id", "time_d", "daily_level", "daily_untouched", F.lit(True).alias("actual")), by="ts_id")
        return with_ensembles(spark, sf, "valicast").join(actual, ["ts_id", "time_d"], "left")

    return once("validation", make, checks.complete("actual"), by="ts_id").drop("actual")


def plugged(spark: SparkSession, models: DataFrame) -> DataFrame:
    """A copy whose missing predictions are the weekday's median, for its own losses; series without any value stay NULL.

    Where there is a median, nothing may be missing any more.
    """
    names = [m for m in (*MODELS, *ENSEMBLES) if m != components.PLUG]
    left = {k: v for m in names for k, v in checks.complete_where(m, components.PLUG).items()}
    return once("plugged", lambda: components.plug_missing(models, names), left, by="ts_id")


def blended(spark: SparkSession, sf: str, models: DataFrame) -> DataFrame:
    """models with the blends by weights from the validation; weights and blends know which predictions are missing."""
    by_series = once("fitted-losses", lambda: ensembles.losses(validation(spark, sf), "daily_untouched", MODELS), by="ts_id")
    for name, k in BLENDS.items():
        models = ensembles.blend(models, ensembles.wide_weights(ensembles.weights(by_series, k), MODELS), MODELS, name)
    return models


@query()
def sarima_fit_variables(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and costs of the four variables of every series and topline."""
    return grouped.specification(fits(spark, sf))


@query()
def stationarity_by_variable(spark: SparkSession, sf: str) -> DataFrame:
    found = parameters(spark, sf).where("func is not null")
    return found.groupBy("variable", "found_stn", "func", "d", "seasonal_d").agg(F.count("*").alias("n"))


@query()
def sarima_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted, validation and forecast samples of the four variables as daily levels."""
    return levels_back(spark, sf)


@query()
def fitted_component_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return matrix(spark, sf, "valicast")


@query()
def pipeline_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Error of every fitted model, ensemble and blend on the validation sample."""
    models = blended(spark, sf, validation(spark, sf))
    return ensembles.losses(models, "daily_untouched", [*MODELS, *ENSEMBLES, *BLENDS], ()).select("model", r("loss"))


@query()
def plugged_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Error of every model and ensemble on the validation sample once missing predictions are plugged."""
    return ensembles.losses(plugged(spark, validation(spark, sf)), "daily_untouched", [*MODELS, *ENSEMBLES], ()).select("model", r("loss"))


@query()
def sarima_failures(spark: SparkSession, sf: str) -> DataFrame:
    """Series and variables without a model, and why."""
    return grouped.failures(fits(spark, sf))


@query()
def sarima_fit_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """sarima_fit_variables by way of a ledger of finished chunks; a restart with the same folder would go on where it stopped."""
    folder = fresh_path(spark, "fit-ledger")
    out = ledger.fit_resumed(stacked(spark, sf), parameters(spark, sf), HORIZONS, folder, chunks=4)
    temporary(spark, folder)
    return grouped.specification(out)


@query()
def pipeline_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts of the days after the panel by every model, ensemble and blend, weights from the validation sample."""
    models = blended(spark, sf, with_ensembles(spark, sf, "forecast"))
    return models.select("ts_id", "time_d", *[rounded(c, 4).alias(c) for c in [*MODELS, *ENSEMBLES, *BLENDS]])
