"""Queries on toplines, statistics, component models, ensembles, weights, submissions and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..operators import backtransform, clean, components, ensembles, panel as panels, report, stats, submission, topline, transform
from ..sarima import grouped
from .basics import _PA_WEEKS, _WG, growth_sql, query, r, rounded, weeks_sql
from .scope import once
from .panels import HORIZON, SERIES_LAGS, TOPLINE_LAGS, clean_sql, panel, panel_sql

MODELS = [*SERIES_LAGS, *TOPLINE_LAGS, *components.SEASONAL_TRUNCATED]
ENSEMBLES = ["ensmod_pointwise_mean", "ensmod_pointwise_median", "ensmod_funcwise_median"]

# ---------------------------------------------------------------- panel pe, its topline and statistics

_LV = f"{panel_sql('pe')}, {clean_sql('pe', ', grp')}, lv AS (SELECT ts_id, grp, time_d, missing_type, daily_untouched, daily_cleaned AS daily_level, (isodow(time_d) - 1)::INT AS day_of_week FROM pe_c)"


def levels(spark: SparkSession, sf: str) -> DataFrame:
    return clean.daily_clean(panel(spark, sf, "pe")).withColumns({"daily_level": F.col("daily_cleaned"), "day_of_week": F.weekday("time_d")})


def kept_levels(spark: SparkSession, sf: str) -> DataFrame:
    """levels() for queries that read them several times."""
    return once("levels", lambda: levels(spark, sf))


_TOP = f"""md AS (SELECT *, median(daily_level) OVER (PARTITION BY ts_id) AS mid FROM lv),
    ts0 AS (SELECT grp, time_d, coalesce(sum(daily_level), 0) AS daily_level_noShrtAdj, coalesce(sum(daily_untouched), 0) AS daily_untouched_noShrtAdj,
        coalesce(sum(CASE WHEN missing_type <> 'missing_short' THEN mid END), 0) AS ok, coalesce(sum(CASE WHEN missing_type = 'missing_short' THEN mid END), 0) AS short FROM md GROUP BY 1, 2),
    tp AS (SELECT grp, time_d, daily_level_noShrtAdj, daily_untouched_noShrtAdj, (short + ok) / nullif(ok, 0) AS shrtAdj_factor, daily_level_noShrtAdj * ((short + ok) / nullif(ok, 0)) AS daily_level_shrtAdj FROM ts0)"""


@query(f"WITH {_LV}, {_TOP} SELECT grp, time_d, round(daily_level_noShrtAdj, 6) AS daily_level_noShrtAdj, daily_untouched_noShrtAdj FROM tp")
def topline_daily(spark: SparkSession, sf: str) -> DataFrame:
    return topline.daily(levels(spark, sf)).select("grp", "time_d", r("daily_level_noShrtAdj"), "daily_untouched_noShrtAdj")


@query(f"""WITH {_LV}, {_TOP} SELECT grp, time_d, (isodow(time_d) - 1)::INT AS day_of_week, round(shrtAdj_factor, 6) AS shrtAdj_factor, round(daily_level_shrtAdj, 4) AS daily_level_shrtAdj,
    round({growth_sql('daily_level_shrtAdj', 7)}, 6) AS daily_wowGr_shrtAdj FROM tp WINDOW w AS (PARTITION BY grp ORDER BY time_d)""")
def topline_short_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    return topline.daily(levels(spark, sf)).select("grp", "time_d", "day_of_week", r("shrtAdj_factor"), rounded("daily_level_shrtAdj", 4).alias("daily_level_shrtAdj"), r("daily_wowGr_shrtAdj"))


@query(f"""WITH {_LV}, {_TOP}, {weeks_sql('tw', 'tp', topline.SUMS, 'grp')}
    SELECT grp, time_w, round(weekly_level_shrtAdj, 4) AS weekly_level_shrtAdj, round(weekly_level_noShrtAdj, 4) AS weekly_level_noShrtAdj, round(weekly_untouched_noShrtAdj, 4) AS weekly_untouched_noShrtAdj,
    round({growth_sql('weekly_level_shrtAdj', 1)}, 6) AS weekly_wowGr_shrtAdj FROM tw WINDOW w AS (PARTITION BY grp ORDER BY time_w)""")
def topline_weekly(spark: SparkSession, sf: str) -> DataFrame:
    weekly = topline.weekly_topline(topline.daily(levels(spark, sf)))
    return weekly.select("grp", "time_w", *[rounded(c, 4).alias(c) for c in topline.SUMS.values()], r("weekly_wowGr_shrtAdj"))


def summary_sql(name: str, keys: str) -> str:
    """CTE <name>: the 18 statistics of lv by keys."""
    parts = []
    for pattern, (first, last) in stats.RANGES.items():
        inside = " AND ".join([*([f"time_d >= anchor - {first}"] if first is not None else []), *([f"time_d <= anchor - {last}"] if last is not None else [])]) or "true"
        x = f"CASE WHEN {inside} THEN daily_level END"
        parts += [f"coalesce(sum({x}), 0) AS {pattern.format('sum')}", f"avg({x}) AS {pattern.format('mean')}", f"median({x}) AS {pattern.format('median')}"]
    return f"{name} AS (SELECT {keys}, {', '.join(parts)} FROM (SELECT *, max(CASE WHEN daily_level IS NOT NULL THEN time_d END) OVER (PARTITION BY {keys}) AS anchor FROM lv) GROUP BY {keys})"


_NAMES = [p.format(s) for p in stats.RANGES for s in stats.STATISTICS]
_ROUNDED = ", ".join(f"round({n}, 4) AS {n}" for n in _NAMES)


@query(f"WITH {_LV}, {summary_sql('so', 'ts_id')} SELECT ts_id, {_ROUNDED} FROM so")
def summary_stats_overall(spark: SparkSession, sf: str) -> DataFrame:
    return stats.summary(levels(spark, sf)).select("ts_id", *[rounded(n, 4).alias(n) for n in _NAMES])


@query(f"WITH {_LV}, {summary_sql('sd', 'ts_id, day_of_week')} SELECT ts_id, day_of_week, {_ROUNDED} FROM sd")
def summary_stats_weekday(spark: SparkSession, sf: str) -> DataFrame:
    return stats.summary(levels(spark, sf), ("ts_id", "day_of_week")).select("ts_id", "day_of_week", *[rounded(n, 4).alias(n) for n in _NAMES])


_PROP = f"""{summary_sql('sg', 'ts_id, grp')}, hp AS (SELECT ts_id, grp, {', '.join(f'{s} / nullif(sum({s}) OVER (PARTITION BY grp), 0) AS {n}' for n, s in stats.SHARES.items())} FROM sg)"""


def shares(spark: SparkSession, sf: str) -> DataFrame:
    return stats.proportions(stats.summary(kept_levels(spark, sf), ("ts_id", "grp")))


@query(f"WITH {_LV}, {_PROP} SELECT ts_id, grp, {', '.join(f'round({n}, 8) AS {n}' for n in stats.SHARES)} FROM hp")
def hist_proportions(spark: SparkSession, sf: str) -> DataFrame:
    return shares(spark, sf).select("ts_id", "grp", *[rounded(n, 8).alias(n) for n in stats.SHARES])


@query(f"WITH {_LV}, {_PROP} SELECT grp, {', '.join(f'sum({n}) AS {n}' for n in stats.SHARES)} FROM hp GROUP BY grp HAVING NOT coalesce({' AND '.join(f'abs(sum({n}) - 1) <= 1e-6' for n in stats.SHARES)}, false)")
def hist_proportions_check(spark: SparkSession, sf: str) -> DataFrame:
    """Must be empty: groups whose shares don't add up to 1."""
    return stats.proportions_check(shares(spark, sf))


_IW = f"""{summary_sql('sd', 'ts_id, day_of_week')},
    iw AS (SELECT ts_id, day_of_week, CASE WHEN sum(trunc60_sum60) OVER (PARTITION BY ts_id) = 0 THEN 1.0 / 7 ELSE trunc60_sum60 / sum(trunc60_sum60) OVER (PARTITION BY ts_id) END AS share FROM sd)"""


def week_shares(spark: SparkSession, sf: str) -> DataFrame:
    return stats.intraweek(stats.summary(kept_levels(spark, sf), ("ts_id", "day_of_week")))


@query(f"WITH {_LV}, {_IW} SELECT ts_id, day_of_week, round(share, 8) AS share FROM iw")
def intraweek_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return week_shares(spark, sf).select("ts_id", "day_of_week", rounded("share", 8).alias("share"))


@query(f"""WITH {_LV}, {_IW}, {weeks_sql('we', 'lv', {'daily_level': 'weekly_level'})}
    SELECT we.ts_id, time_w + (day_of_week - 6)::INT AS time_d, round(weekly_level * share, 4) AS weekly_level FROM we JOIN iw USING (ts_id)""")
def weekly_to_daily(spark: SparkSession, sf: str) -> DataFrame:
    weekly = transform.weekly(kept_levels(spark, sf), {"daily_level": "weekly_level"})
    return backtransform.weekly_to_daily(weekly, week_shares(spark, sf), ["weekly_level"]).withColumn("weekly_level", rounded("weekly_level", 4))


@query(f"""WITH {panel_sql('pa')}, {clean_sql('pa')}, lv AS (SELECT ts_id, time_d, daily_cleaned AS daily_level, (isodow(time_d) - 1)::INT AS day_of_week, {growth_sql('daily_cleaned', 7)} AS g FROM pa_c WINDOW w AS (PARTITION BY ts_id ORDER BY time_d)),
    {_IW}, {_PA_WEEKS}, {_WG}, hi AS (SELECT max(time_d) AS d, (SELECT max(time_w) FROM wg) AS w FROM lv),
    va AS (SELECT * FROM lv WHERE time_d > (SELECT d - 60 FROM hi)), vw AS (SELECT * FROM wg WHERE time_w > (SELECT w - 70 FROM hi)),
    sx AS (SELECT ts_id, day_of_week, daily_level AS seed FROM lv WHERE time_d > (SELECT d - 67 FROM hi) AND time_d <= (SELECT d - 60 FROM hi)),
    da AS (SELECT va.ts_id, time_d, daily_level AS daily_level_predbt, seed * product(1 + g) OVER (PARTITION BY va.ts_id, va.day_of_week ORDER BY time_d ROWS UNBOUNDED PRECEDING) AS daily_wowGr_predbt FROM va JOIN sx USING (ts_id, day_of_week)),
    ww AS (SELECT vw.ts_id, vw.time_w, vw.weekly_level, p.weekly_level * product(1 + vw.g) OVER (PARTITION BY vw.ts_id ORDER BY vw.time_w ROWS UNBOUNDED PRECEDING) AS wl FROM vw JOIN wg p ON p.ts_id = vw.ts_id AND p.time_w = (SELECT w - 70 FROM hi)),
    wd AS (SELECT ww.ts_id, time_w + (day_of_week - 6)::INT AS time_d, weekly_level * share AS a, wl * share AS b FROM ww JOIN iw USING (ts_id))
    SELECT da.ts_id, da.time_d, round(daily_level_predbt, 4) AS daily_level_predbt, round(daily_wowGr_predbt, 4) AS daily_wowGr_predbt, round(a, 4) AS weekly_level_predbt, round(b, 4) AS weekly_wowGr_predbt
    FROM da LEFT JOIN wd ON wd.ts_id = da.ts_id AND wd.time_d = da.time_d""")
def back_transform_all(spark: SparkSession, sf: str) -> DataFrame:
    full = once("growth", lambda: transform.daily_growth(clean.daily_clean(panel(spark, sf, "pa")).withColumn("daily_level", F.col("daily_cleaned"))))
    weeks = transform.weekly_growth(transform.weekly(full, {"daily_level": "weekly_level"}))
    share = stats.intraweek(stats.summary(full, ("ts_id", "day_of_week")))
    last_weeks = weeks.join(F.broadcast(weeks.agg(F.date_sub(F.max("time_w"), 63).alias("from"))), F.col("time_w") >= F.col("from")).drop("from")
    out = backtransform.back_transform(report.last_days(full, HORIZON), last_weeks, full, weeks, share)
    return out.select("ts_id", "time_d", *[rounded(c, 4).alias(c) for c in out.columns if c.endswith("_predbt")])


def _distributed(spark: SparkSession, sf: str) -> DataFrame:
    return topline.distribute(topline.daily(kept_levels(spark, sf)), shares(spark, sf), ["daily_level_noShrtAdj"], "hist_prop_last60days")


@query(f"WITH {_LV}, {_TOP}, {_PROP} SELECT ts_id, time_d, grp, round(daily_level_noShrtAdj * hist_prop_last60days, 4) AS daily_level_noShrtAdj FROM tp JOIN hp USING (grp)")
def distribute_topline(spark: SparkSession, sf: str) -> DataFrame:
    return _distributed(spark, sf).withColumn("daily_level_noShrtAdj", rounded("daily_level_noShrtAdj", 4))


@query(f"""WITH {_LV}, {_TOP}, {_PROP}, di AS (SELECT grp, sum(daily_level_noShrtAdj * hist_prop_last60days) AS a FROM tp JOIN hp USING (grp) GROUP BY 1), t AS (SELECT grp, sum(daily_level_noShrtAdj) AS b FROM tp GROUP BY 1)
    SELECT grp, abs(a - b) <= 1e-8 * abs(b) AS conserved FROM di JOIN t USING (grp)""")
def distribute_conservation(spark: SparkSession, sf: str) -> DataFrame:
    given = topline.daily(kept_levels(spark, sf)).groupBy("grp").agg(F.sum("daily_level_noShrtAdj").alias("b"))
    dealt = _distributed(spark, sf).groupBy("grp").agg(F.sum("daily_level_noShrtAdj").alias("a"))
    return given.join(dealt, "grp").select("grp", (F.abs(F.col("a") - F.col("b")) <= 1e-8 * F.abs("b")).alias("conserved"))


# ---------------------------------------------------------------- component models on the validation sample

_LIM = "cutd AS (SELECT max(time_d) - 60 AS cut FROM lv), lim AS (SELECT ts_id, max(daily_level) * 10 AS trimmax, max(CASE WHEN time_d < cut THEN daily_level END) * 10 AS trimmax_trunc60 FROM lv, cutd GROUP BY 1)"


@query(f"WITH {_LV}, {_LIM} SELECT ts_id, round(trimmax, 4) AS trimmax, round(trimmax_trunc60, 4) AS trimmax_trunc60 FROM lim")
def trim_limits(spark: SparkSession, sf: str) -> DataFrame:
    return components.trim_limits(levels(spark, sf)).select("ts_id", rounded("trimmax", 4).alias("trimmax"), rounded("trimmax_trunc60", 4).alias("trimmax_trunc60"))


_SM = f"""sm AS (SELECT * FROM (SELECT ts_id, time_d, {', '.join(f'lag(daily_level, {k}) OVER w AS {m}' for m, k in SERIES_LAGS.items())} FROM lv WINDOW w AS (PARTITION BY ts_id ORDER BY time_d))
        WHERE time_d > (SELECT max(time_d) - 60 FROM lv)),
    gm AS (SELECT * FROM (SELECT grp, time_d, {', '.join(f'lag(daily_level_noShrtAdj, {k}) OVER w AS {m}' for m, k in TOPLINE_LAGS.items())} FROM tp WINDOW w AS (PARTITION BY grp ORDER BY time_d))
        WHERE time_d > (SELECT max(time_d) - 60 FROM lv)),
    am AS (SELECT ts_id, time_d, {', '.join(f"{m} * hist_prop_trunc60_last60days AS {m}" for m in TOPLINE_LAGS)} FROM gm JOIN hp USING (grp))"""


_MM = f"""{_PROP}, {summary_sql('sd', 'ts_id, day_of_week')}, {_SM},
    mm AS (SELECT sm.ts_id, sm.time_d, {', '.join(f"CASE WHEN {m} IS NOT NULL AND trimmax_trunc60 IS NOT NULL THEN least({m}, trimmax_trunc60) END AS {m}" for m in (*SERIES_LAGS, *TOPLINE_LAGS))},
        {', '.join(f'sd.{s} AS {m}' for m, s in components.SEASONAL_TRUNCATED.items())}
        FROM sm JOIN am ON am.ts_id = sm.ts_id AND am.time_d = sm.time_d JOIN lim ON lim.ts_id = sm.ts_id JOIN sd ON sd.ts_id = sm.ts_id AND sd.day_of_week = isodow(sm.time_d) - 1)"""
_MATRIX = f"{_LV}, {_TOP}, {_LIM}, {_MM}"


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The 12 component models of panel pe on the last 60 days; lagged levels stand in for the fitted ones."""
    return once("matrix", lambda: _matrix(spark, sf))


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    lv = kept_levels(spark, sf)
    lagged = lambda df, by, value, lags: df.select(by, "time_d", *[F.lag(value, k).over(Window.partitionBy(by).orderBy("time_d")).alias(m) for m, k in lags.items()])
    own = report.last_days(lagged(lv, "ts_id", "daily_level", SERIES_LAGS), HORIZON)
    top = report.last_days(lagged(topline.daily(lv), "grp", "daily_level_noShrtAdj", TOPLINE_LAGS), HORIZON)
    top = topline.distribute(top, stats.proportions(stats.summary(lv, ("ts_id", "grp"))), list(TOPLINE_LAGS), "hist_prop_trunc60_last60days").drop("grp")
    weekday = stats.summary(lv, ("ts_id", "day_of_week"))
    return components.matrix(own, top, components.trim_limits(lv), weekday, "trimmax_trunc60", components.SEASONAL_TRUNCATED)


@query(f"WITH {_MATRIX} SELECT ts_id, time_d, {', '.join(f'round({m}, 4) AS {m}' for m in MODELS)} FROM mm")
def component_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return matrix(spark, sf).select("ts_id", "time_d", *[rounded(m, 4).alias(m) for m in MODELS])


_LIST = f"list_filter([{', '.join(MODELS)}], lambda x: x IS NOT NULL)"
_FW = f"""sums AS ({' UNION ALL '.join(f"SELECT ts_id, '{m}' AS model, coalesce(sum({m}), 0) AS s FROM mm GROUP BY 1" for m in MODELS)}),
    rk AS (SELECT *, row_number() OVER (PARTITION BY ts_id ORDER BY s, model) AS k, avg(s) OVER (PARTITION BY ts_id) AS mid FROM sums),
    ch AS (SELECT ts_id, arg_min(model, (abs(s - mid), s, model)) AS chosen FROM rk WHERE k IN (7, 8) GROUP BY 1)"""
_ENS = f"""{_FW}, en AS (SELECT mm.*, list_sum({_LIST}) / nullif(len({_LIST}), 0) AS ensmod_pointwise_mean, list_aggregate({_LIST}, 'median') AS ensmod_pointwise_median,
        CASE chosen {' '.join(f"WHEN '{m}' THEN {m}" for m in MODELS)} END AS ensmod_funcwise_median FROM mm JOIN ch ON ch.ts_id = mm.ts_id)"""


def with_ensembles(spark: SparkSession, sf: str) -> DataFrame:
    return ensembles.functionwise(ensembles.pointwise(matrix(spark, sf), MODELS), MODELS)


def _ensemble(name: str, column: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return with_ensembles(spark, sf).select("ts_id", "time_d", rounded(column, 4).alias(column))

    query(f"WITH {_MATRIX}, {_ENS} SELECT ts_id, time_d, round({column}, 4) AS {column} FROM en", name)(run)


for _name, _column in zip(("ensemble_pointwise_mean", "ensemble_pointwise_median", "ensemble_funcwise_median"), ENSEMBLES, strict=True):
    _ensemble(_name, _column)

# ---------------------------------------------------------------- losses, ranks, weights, blends


def smape_sql(f: str, a: str) -> str:
    return f"100 * avg(CASE WHEN {f} = 0 AND {a} = 0 THEN 0 WHEN {f} IS NOT NULL AND {a} IS NOT NULL THEN abs({f} - {a}) / ((abs({a}) + abs({f})) / 2) END)"


_ACT = f"ac AS (SELECT mm.*, l.daily_level, l.daily_untouched FROM mm JOIN lv l ON l.ts_id = mm.ts_id AND l.time_d = mm.time_d)"
_LOSS = "lo AS (" + " UNION ALL ".join(f"SELECT ts_id, '{m}' AS model, {smape_sql(m, 'daily_untouched')} AS loss FROM ac GROUP BY 1" for m in MODELS) + ")"
_LOSSES = f"{_MATRIX}, {_ACT}, {_LOSS}"


def with_actuals(spark: SparkSession, sf: str) -> DataFrame:
    actual = report.last_days(kept_levels(spark, sf), HORIZON).select("ts_id", "time_d", "daily_level", "daily_untouched")
    return matrix(spark, sf).join(actual, ["ts_id", "time_d"])


def series_losses(spark: SparkSession, sf: str) -> DataFrame:
    return ensembles.losses(with_actuals(spark, sf), "daily_untouched", MODELS)


@query(f"WITH {_LOSSES} " + " UNION ALL ".join(f"SELECT '{m}' AS model, round({smape_sql(m, 'daily_untouched')}, 6) AS loss FROM ac" for m in MODELS))
def smape_overall(spark: SparkSession, sf: str) -> DataFrame:
    return ensembles.losses(with_actuals(spark, sf), "daily_untouched", MODELS, ()).select("model", r("loss"))


@query(f"WITH {_LOSSES} SELECT ts_id, model, round(loss, 6) AS loss FROM lo")
def smape_by_series(spark: SparkSession, sf: str) -> DataFrame:
    return series_losses(spark, sf).select("ts_id", "model", r("loss"))


_COMPLETE = " AND ".join(f"{m} IS NOT NULL" for m in (*MODELS, "daily_untouched"))


@query(f"WITH {_LOSSES} " + " UNION ALL ".join(f"SELECT '{m}' AS model, round({smape_sql(m, 'daily_untouched')}, 6) AS loss FROM ac WHERE {_COMPLETE}" for m in MODELS))
def smape_complete_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ensembles.complete_losses(with_actuals(spark, sf), "daily_untouched", MODELS).select("model", r("loss"))


@query(f"WITH {_LOSSES} " + " UNION ALL ".join(f"SELECT ts_id, '{m}' AS model, round(avg(({m} - daily_untouched) * ({m} - daily_untouched)), 4) AS loss FROM ac GROUP BY 1" for m in MODELS))
def mse_by_series(spark: SparkSession, sf: str) -> DataFrame:
    return ensembles.mean_squared(with_actuals(spark, sf), "daily_untouched", MODELS).select("ts_id", "model", rounded("loss", 4).alias("loss"))


_DESCRIBE = 'count({0}) AS count, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std, round(min({0}), 6) AS min, round(quantile_cont({0}, 0.25), 6) AS p25, round(quantile_cont({0}, 0.5), 6) AS p50, round(quantile_cont({0}, 0.75), 6) AS p75, round(max({0}), 6) AS max'


def _described(df: DataFrame, *group: str) -> DataFrame:
    return df.select(*group, "count", *[r(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


@query(f"WITH {_LOSSES} SELECT model, {_DESCRIBE.format('loss')} FROM lo GROUP BY 1")
def losses_describe(spark: SparkSession, sf: str) -> DataFrame:
    return _described(stats.describe(series_losses(spark, sf), ["loss"], ("model",)), "model")


@query(f"WITH {_LOSSES} " + " UNION ALL ".join(f"SELECT '{m}' AS \"column\", round(count({m}) / count(*), 6) AS share FROM ac" for m in MODELS))
def nonmissing_share(spark: SparkSession, sf: str) -> DataFrame:
    return report.present_share(with_actuals(spark, sf), MODELS).select("column", r("share"))


@query(f"WITH {_MATRIX} SELECT ts_id, time_d, {', '.join(f'round(coalesce({m}, {components.PLUG}), 4) AS {m}' for m in MODELS)} FROM mm")
def plug_missing(spark: SparkSession, sf: str) -> DataFrame:
    return components.plug_missing(matrix(spark, sf), MODELS).select("ts_id", "time_d", *[rounded(m, 4).alias(m) for m in MODELS])


_RANK = "ra AS (SELECT *, row_number() OVER (PARTITION BY ts_id ORDER BY loss ASC NULLS LAST, model) AS model_rank FROM lo)"


@query(f"WITH {_LOSSES}, {_RANK} SELECT ts_id, model, model_rank::INT AS model_rank, round(loss, 6) AS loss FROM ra")
def model_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ensembles.ranks(series_losses(spark, sf)).select("ts_id", "model", "model_rank", r("loss"))


@query(f"WITH {_LOSSES}, {_RANK} SELECT ts_id, model, model_rank::INT AS model_rank FROM ra WHERE model_rank <= 5")
def top_k_models(spark: SparkSession, sf: str) -> DataFrame:
    return ensembles.ranks(series_losses(spark, sf)).where("model_rank <= 5").select("ts_id", "model", "model_rank")


@query(f"WITH {_LOSSES}, ov AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, {smape_sql(m, 'daily_untouched')} AS loss FROM ac" for m in MODELS) + ") SELECT arg_min(model, (loss, model)) AS model, round(min(loss), 6) AS loss FROM ov WHERE loss IS NOT NULL")
def best_model(spark: SparkSession, sf: str) -> DataFrame:
    return ensembles.best_model(ensembles.losses(with_actuals(spark, sf), "daily_untouched", MODELS, ())).select("model", r("loss"))


def weights_sql(k: int) -> str:
    """CTEs w<k> (long) and x<k> (wide)."""
    return f"""w{k} AS (SELECT ts_id, model, CASE WHEN count(loss) OVER (PARTITION BY ts_id) = 0 THEN 1.0 / count(*) OVER (PARTITION BY ts_id) ELSE w / nullif(sum(w) OVER (PARTITION BY ts_id), 0) END AS weight
        FROM (SELECT *, CASE WHEN model_rank <= {k} THEN coalesce(1 / (loss + 0.001), 0) ELSE 0 END AS w FROM ra)),
    x{k} AS (SELECT ts_id, {', '.join(f"max(CASE WHEN model = '{m}' THEN weight END) AS reWt_{m}" for m in MODELS)} FROM w{k} GROUP BY 1)"""


def _weights(k: int) -> None:
    def wide(spark: SparkSession, sf: str) -> DataFrame:
        out = ensembles.wide_weights(ensembles.weights(series_losses(spark, sf), k), MODELS)
        return out.select("ts_id", *[rounded(c, 8).alias(c) for c in out.columns[1:]])

    query(f"WITH {_LOSSES}, {_RANK}, {weights_sql(k)} SELECT ts_id, {', '.join(f'round(reWt_{m}, 8) AS reWt_{m}' for m in MODELS)} FROM x{k}", f"weights_top{k}")(wide)

    def blended(spark: SparkSession, sf: str) -> DataFrame:
        models = with_actuals(spark, sf)
        weight = ensembles.wide_weights(ensembles.weights(ensembles.losses(models, "daily_untouched", MODELS), k), MODELS)
        out = ensembles.blend(models, weight, MODELS, "blend")
        return out.select("ts_id", "time_d", rounded("blend", 4).alias("blend"))

    total = " + ".join(f"CASE WHEN reWt_{m} <> 0 THEN reWt_{m} * coalesce({m}, 0) ELSE 0 END" for m in MODELS)
    query(f"WITH {_LOSSES}, {_RANK}, {weights_sql(k)} SELECT ac.ts_id, time_d, round({total}, 4) AS blend FROM ac JOIN x{k} ON x{k}.ts_id = ac.ts_id", f"blend_top{k}")(blended)


for _k in (1, 5):
    _weights(_k)


@query(f"WITH {_LOSSES}, {_RANK}, {weights_sql(1)}, {weights_sql(5)} SELECT model, round(avg(w1.weight), 8) AS top1, round(avg(w5.weight), 8) AS top5 FROM w1 JOIN w5 USING (ts_id, model) GROUP BY 1")
def weights_mean(spark: SparkSession, sf: str) -> DataFrame:
    by_series = series_losses(spark, sf)
    mean = lambda k: ensembles.weights(by_series, k).groupBy("model").agg(rounded(F.avg("weight"), 8).alias(f"top{k}"))
    return mean(1).join(mean(5), "model")


@query(f"WITH {_LOSSES}, {_RANK} SELECT model_rank::INT AS model_rank, round(avg(loss), 6) AS loss, count(loss) AS n FROM ra GROUP BY 1")
def smape_by_rank(spark: SparkSession, sf: str) -> DataFrame:
    return report.loss_by_rank(ensembles.ranks(series_losses(spark, sf))).select("model_rank", r("loss"), "n")


# ---------------------------------------------------------------- submission

_KEY = "sk AS (SELECT ts_id, time_d, md5(ts_id || '_' || strftime(time_d, '%Y-%m-%d')) AS Id FROM (SELECT DISTINCT ts_id FROM lv) CROSS JOIN (SELECT DISTINCT time_d FROM lv WHERE time_d > (SELECT max(time_d) - 60 FROM lv)))"


def _key(spark: SparkSession, sf: str) -> DataFrame:
    """Key rows as a submission file has them: a dated page and an id."""
    rows = report.last_days(kept_levels(spark, sf), HORIZON).select(F.concat("ts_id", F.lit("_"), F.date_format("time_d", "yyyy-MM-dd")).alias("Page"))
    keyed = rows.withColumn("Id", F.md5("Page")).withColumns({"ts_id": F.regexp_extract("Page", "^(.*)_([^_]*)$", 1), "time_d": F.to_date(F.regexp_extract("Page", "^(.*)_([^_]*)$", 2))})
    return keyed.select("ts_id", "time_d", "Id")


@query(f"WITH {_MATRIX}, {_KEY} SELECT sk.ts_id, sk.time_d, Id, {', '.join(f'round({m}, 4) AS {m}' for m in MODELS)} FROM sk LEFT JOIN mm ON mm.ts_id = sk.ts_id AND mm.time_d = sk.time_d")
def submission_join(spark: SparkSession, sf: str) -> DataFrame:
    return submission.submission(matrix(spark, sf), _key(spark, sf)).select("ts_id", "time_d", "Id", *[rounded(m, 4).alias(m) for m in MODELS])


@query(f"WITH {_MATRIX}, {_KEY}, ac AS (SELECT mm.*, l.daily_untouched FROM mm JOIN sk ON sk.ts_id = mm.ts_id AND sk.time_d = mm.time_d JOIN lv l ON l.ts_id = mm.ts_id AND l.time_d = mm.time_d) "
       + " UNION ALL ".join(f"SELECT '{m}' AS model, round({smape_sql(m, 'daily_untouched')}, 6) AS loss FROM ac" for m in MODELS))
def score_submission(spark: SparkSession, sf: str) -> DataFrame:
    key = _key(spark, sf)
    solution = kept_levels(spark, sf).join(key, ["ts_id", "time_d"]).select("Id", F.col("daily_untouched").alias("Visits"))
    return submission.score(submission.submission(matrix(spark, sf), key), submission.truth(solution, key), MODELS).select("model", r("loss"))


# ---------------------------------------------------------------- reports


@query(f"WITH {panel_sql('pc')} SELECT ts_id, coalesce(sum(daily_untouched), 0) AS total FROM pc WHERE ts_id NOT LIKE '%7%' GROUP BY 1 ORDER BY total DESC, ts_id LIMIT 20")
def top_n_series(spark: SparkSession, sf: str) -> DataFrame:
    return report.top_series(panel(spark, sf, "pc"), "daily_untouched", 20, ("7",))


@query("""WITH s AS (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem)
    SELECT 'l_returnflag' AS "column", l_returnflag AS value, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM s GROUP BY 2
    UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, count(*) FROM s GROUP BY 2""")
def counts_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    by = ["l_returnflag", "l_linestatus", "l_linenumber"]
    return report.counts_each(spark.read.parquet(f"{sf}/lineitem.parquet").select(*by).distinct(), by)


@query(f"WITH {_LV} SELECT day_of_week, round(sum(daily_level), 4) AS total FROM lv GROUP BY 1")
def weekday_totals(spark: SparkSession, sf: str) -> DataFrame:
    return levels(spark, sf).groupBy("day_of_week").agg(rounded(F.sum("daily_level"), 4).alias("total"))


@query(f"WITH {_LV}, m AS (SELECT ts_id, median(daily_level) AS mid FROM lv GROUP BY 1) SELECT {_DESCRIBE.format('mid')} FROM m")
def median_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return _described(stats.describe(levels(spark, sf).groupBy("ts_id").agg(F.median("daily_level").alias("mid")), ["mid"]))


@query("""WITH p AS (SELECT event_type, date_trunc('week', CAST(ts AS DATE))::DATE + 6 AS time_w, value FROM events)
    SELECT event_type, time_w, count(*) AS n, round(sum(value), 4) AS total FROM p GROUP BY 1, 2""")
def weekly_event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The batch form of the stream in tessera.streaming."""
    from ..streaming.weekly import weekly_stream

    return weekly_stream(spark.read.parquet(f"{sf}/events.parquet"), "event_type").withColumn("total", rounded("total", 4))


# ---------------------------------------------------------------- seasonal ARIMA


def _whole(spark: SparkSession, sf: str) -> DataFrame:
    return clean.daily_clean(panel(spark, sf, "pa"))


def _fitted(spark: SparkSession, sf: str, panel_: DataFrame) -> DataFrame:
    from ..operators import stationarity

    params = stationarity.search_with_log(panel_, "daily_cleaned")
    return grouped.fit_panel(panel_, params, "daily_cleaned", 60, 70)


@query()
def sarima_fit_series(spark: SparkSession, sf: str) -> DataFrame:
    return _fitted(spark, sf, _whole(spark, sf))


@query()
def sarima_fit_topline(spark: SparkSession, sf: str) -> DataFrame:
    total = _whole(spark, sf).groupBy("time_d").agg(F.sum("daily_cleaned").alias("daily_cleaned")).withColumn("ts_id", F.lit("all"))
    return _fitted(spark, sf, total)


@query()
def sarima_spec(spark: SparkSession, sf: str) -> DataFrame:
    return grouped.specification(sarima_fit_series(spark, sf))


_BLENDS = ["postValiMod_ens_ranked1", "postValiMod_ens_ranked5"]
_BLENDED = ", ".join(f"{' + '.join(f'CASE WHEN x{k}.reWt_{m} <> 0 THEN x{k}.reWt_{m} * coalesce(ac.{m}, 0) ELSE 0 END' for m in MODELS)} AS {b}" for k, b in zip((1, 5), _BLENDS, strict=True))


@query(f"""WITH {_MATRIX}, {_ENS}, ac AS (SELECT en.*, l.daily_untouched FROM en JOIN lv l ON l.ts_id = en.ts_id AND l.time_d = en.time_d),
    {_LOSS}, {_RANK}, {weights_sql(1)}, {weights_sql(5)}, bl AS (SELECT ac.*, {_BLENDED} FROM ac JOIN x1 ON x1.ts_id = ac.ts_id JOIN x5 ON x5.ts_id = ac.ts_id) """
       + " UNION ALL ".join(f"SELECT '{m}' AS model, round({smape_sql(m, 'daily_untouched')}, 6) AS loss FROM bl" for m in [*MODELS, *ENSEMBLES, *_BLENDS]))
def forecast_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Clean, components, ensembles, losses, ranks, weights, blends and the final score of every model."""
    models = once("ensembles", lambda: ensembles.functionwise(ensembles.pointwise(with_actuals(spark, sf), MODELS), MODELS))
    by_series = once("losses", lambda: ensembles.losses(models, "daily_untouched", MODELS))
    for k, name in zip((1, 5), _BLENDS, strict=True):
        models = ensembles.blend(models, ensembles.wide_weights(ensembles.weights(by_series, k), MODELS), MODELS, name)
    return ensembles.losses(models, "daily_untouched", [*MODELS, *ENSEMBLES, *_BLENDS], ()).select("model", r("loss"))


@query(f"WITH {_MATRIX}, {_ENS}, ac AS (SELECT en.*, l.daily_untouched FROM en JOIN lv l ON l.ts_id = en.ts_id AND l.time_d = en.time_d), ov AS ("
       + " UNION ALL ".join(f"SELECT '{m}' AS model, {smape_sql(m, 'daily_untouched')} AS loss FROM ac" for m in ENSEMBLES)
       + ") SELECT arg_min(model, (loss, model)) AS model, round(min(loss), 6) AS loss FROM ov WHERE loss IS NOT NULL")
def best_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    models = ensembles.functionwise(ensembles.pointwise(with_actuals(spark, sf), MODELS), MODELS)
    return ensembles.best_model(ensembles.losses(models, "daily_untouched", ENSEMBLES, ())).select("model", r("loss"))


@query(f"WITH {_LV}, n AS (SELECT ts_id, count(*) AS n FROM lv GROUP BY 1) SELECT ts_id, n, (SELECT max(n) FROM n) AS most FROM n WHERE n <> (SELECT max(n) FROM n)")
def equal_lengths_check(spark: SparkSession, sf: str) -> DataFrame:
    """Must be empty: series with fewer rows than the longest."""
    return ensembles.lengths_check(levels(spark, sf))


_PAGES = "SELECT row_number() OVER (ORDER BY l_returnflag, l_linestatus, l_linenumber) - 1 AS ts_id, l_returnflag || '_x' AS name, l_linestatus AS project, 'all' AS access, l_linenumber::VARCHAR AS agent FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem)"


@query(f"""WITH p AS ({_PAGES}), d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS time_d FROM lineitem)
    SELECT p.*, time_d, md5(name || '_' || project || '_' || access || '_' || agent || '_' || strftime(time_d, '%Y-%m-%d')) AS Id FROM p CROSS JOIN d""")
def submission_page_map(spark: SparkSession, sf: str) -> DataFrame:
    """Dated page keys and their series' ids, by the four parts of the page."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    parts = lines.select(F.concat("l_returnflag", F.lit("_x")).alias("name"), F.col("l_linestatus").alias("project"), F.lit("all").alias("access"), F.col("l_linenumber").alias("agent"))
    pages = panels.series_ids(parts, ["name", "project", "access", "agent"]).withColumn("agent", F.col("agent").cast("string"))
    days = lines.select(F.col("l_shipdate").cast("date").alias("time_d")).distinct()
    dated = pages.join(F.broadcast(days)).select(F.concat_ws("_", "name", "project", "access", "agent", F.date_format("time_d", "yyyy-MM-dd")).alias("Page")).withColumn("Id", F.md5("Page"))
    return submission.with_series(submission.parse_dated_key(dated), pages).drop("Page")


@query(f"""WITH p AS ({_PAGES}), t AS (SELECT l_returnflag || '_x' AS name, l_linestatus AS project, l_linenumber::VARCHAR AS agent, coalesce(sum(l_quantity), 0) AS total FROM lineitem GROUP BY ALL)
    SELECT ts_id, total, name, project, access, agent FROM p JOIN t USING (name, project, agent)
    WHERE project = 'O' AND access = 'all' AND NOT contains(name, 'R_') AND NOT starts_with(name, 'X') ORDER BY total DESC, ts_id LIMIT 200""")
def top_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The most visited pages of one project and access, by the map of pages and without special names."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.concat("l_returnflag", F.lit("_x")).alias("name"), F.col("l_linestatus").alias("project"), F.lit("all").alias("access"), F.col("l_linenumber").alias("agent"), "l_quantity")
    parts = ["name", "project", "access", "agent"]
    pages = once("pages", lambda: panels.series_ids(lines.select(*parts), parts))
    visits = lines.join(pages, parts).select("ts_id", "l_quantity")
    return report.top_pages(visits, pages.withColumn("agent", F.col("agent").cast("string")), "l_quantity", 200, {"project": "O", "access": "all"}, ("R_",), ("X",))
