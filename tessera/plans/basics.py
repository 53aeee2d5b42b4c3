"""Queries on building, cleaning, growth, weeks, holidays and stationarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import split_right
from ..operators import backtransform, clean, holidays, panel as panels, report, stationarity, transform
from .scope import scoped
from .panels import SPARSE, clean_sql, panel, panel_sql, spiked, spiked_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


#: Added before rounding, so that exact ties and zeros of either sign come out alike in both engines.
NUDGE = 1e-9


def rounded(x, digits: int):
    return F.round((F.col(x) if isinstance(x, str) else x) + NUDGE, digits)


def nudged(sql: str) -> str:
    """The SQL with NUDGE added to the first argument of every round()."""
    out, rest = "", sql
    while (at := rest.find("round(")) >= 0:
        depth, comma = 1, -1
        for k in range(at + 6, len(rest)):
            depth += (rest[k] == "(") - (rest[k] == ")")
            if rest[k] == "," and depth == 1:
                comma = k
            if depth == 0:
                break
        out, rest = out + rest[: at + 6] + "(" + nudged(rest[at + 6 : comma]) + f") + {NUDGE}::DOUBLE", rest[comma:]
    return out + rest


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame and its SQL under its name."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = scoped(f)
        if sql is not None:
            SQL[key] = nudged(sql)
        return f

    return add


def r(column: str, to: str | None = None):
    return rounded(column, 6).alias(to or column)


_W = "WINDOW w AS (PARTITION BY ts_id ORDER BY time_d)"


@query(f"WITH {panel_sql('pa')} SELECT ts_id, time_d, daily_untouched FROM pa")
def panel_daily_dense(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf, "pa").select("ts_id", "time_d", "daily_untouched")


_PAGE = "o_orderpriority || '_' || o_orderstatus || '.wiki_' || (o_custkey % 3)::VARCHAR || '-access_' || (o_custkey % 2)::VARCHAR"


@query(f"""SELECT DISTINCT page, regexp_extract(page, '^(.*)_([^_]*)_([^_]*)_([^_]*)$', 1) AS name, regexp_extract(page, '^(.*)_([^_]*)_([^_]*)_([^_]*)$', 2) AS project,
    regexp_extract(page, '^(.*)_([^_]*)_([^_]*)_([^_]*)$', 3) AS access, regexp_extract(page, '^(.*)_([^_]*)_([^_]*)_([^_]*)$', 4) AS agent
    FROM (SELECT 'a_b_' || {_PAGE} AS page FROM orders)""")
def key_rsplit(spark: SparkSession, sf: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    parts = ["o_orderpriority", F.lit("_"), "o_orderstatus", F.lit(".wiki_"), (F.col("o_custkey") % 3).cast("string"), F.lit("-access_"), (F.col("o_custkey") % 2).cast("string")]
    page = orders.select(F.concat(F.lit("a_b_"), *parts).alias("page")).distinct()
    return page.select("page", *[c.alias(n) for c, n in zip(split_right(F.col("page"), 4), ("name", "project", "access", "agent"), strict=True)])


@query("""SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderstatus) - 1 AS ts_id, o_orderpriority, o_orderstatus
    FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders)""")
def series_id_map(spark: SparkSession, sf: str) -> DataFrame:
    return panels.series_ids(spark.read.parquet(f"{sf}/orders.parquet"), ["o_orderpriority", "o_orderstatus"])


_JANUARY = [f"2024-01-{d:02d}" for d in range(1, 31)]


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    return panels.long_to_wide(SPARSE["pd"](spark, sf), ["ts_id"], F.date_format("time_d", "yyyy-MM-dd"), _JANUARY, "daily_untouched")


@query(f"""WITH {panel_sql('pd')} SELECT ts_id, {', '.join(f"max(CASE WHEN strftime(time_d, '%Y-%m-%d') = '{d}' THEN x END) AS \"{d}\"" for d in _JANUARY)} FROM pd_raw GROUP BY ts_id""")
def long_to_wide(spark: SparkSession, sf: str) -> DataFrame:
    return _wide(spark, sf)


@query(f"""WITH {panel_sql('pd')}, d AS (SELECT unnest(range(1, 31)) AS k)
    SELECT s.ts_id, CAST(make_date(2024, 1, d.k::INT) AS DATE) AS time_d, x AS daily_untouched FROM (SELECT DISTINCT ts_id FROM pd_raw) s CROSS JOIN d
    LEFT JOIN pd_raw ON pd_raw.ts_id = s.ts_id AND pd_raw.time_d = make_date(2024, 1, d.k::INT)""")
def wide_to_long(spark: SparkSession, sf: str) -> DataFrame:
    return panels.wide_to_long(_wide(spark, sf), ["ts_id"], "daily_untouched")


@query(f"WITH {panel_sql('pc')}, {clean_sql('pc')} SELECT ts_id, time_d, missing_type FROM pc_c")
def missing_type(spark: SparkSession, sf: str) -> DataFrame:
    return clean.with_missing_type(panel(spark, sf, "pc")).select("ts_id", "time_d", "missing_type")


@query(f"WITH {panel_sql('pa')}, {clean_sql('pa')} SELECT ts_id, time_d, round(rm, 6) AS rolling_mean FROM pa_t")
def rolling_mean_centered_30(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf, "pa").withColumn("rolling_mean", clean.rolling_mean()).select("ts_id", "time_d", r("rolling_mean"))


@query(f"WITH {panel_sql('pa')}, {clean_sql('pa')} SELECT ts_id, time_d, outlier FROM pa_o")
def outlier_flags(spark: SparkSession, sf: str) -> DataFrame:
    return clean.with_outliers(panel(spark, sf, "pa")).select("ts_id", "time_d", "outlier")


@query(f"WITH {panel_sql('pa')} SELECT ts_id, time_d, (lag(daily_untouched, 7) OVER w + lead(daily_untouched, 7) OVER w) / 2 AS neighbour FROM pa {_W}")
def impute_weekday_neighbour(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf, "pa").select("ts_id", "time_d", clean.neighbour_mean(F.col("daily_untouched")).alias("neighbour"))


@query(f"WITH {panel_sql('pc')} SELECT ts_id, time_d, last_value(daily_untouched IGNORE NULLS) OVER (PARTITION BY ts_id ORDER BY time_d ROWS UNBOUNDED PRECEDING) AS filled FROM pc")
def forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    return panel(spark, sf, "pc").select("ts_id", "time_d", clean.forward_fill(F.col("daily_untouched")).alias("filled"))


def _cleaned(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return clean.daily_clean(panel(spark, sf, name))


def _clean_sql(name: str) -> str:
    return f"WITH {panel_sql(name)}, {clean_sql(name)} SELECT ts_id, time_d, daily_untouched, missing_type, outlier, round(daily_cleaned, 6) AS daily_cleaned FROM {name}_c"


@query(_clean_sql("pa"))
def daily_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _cleaned(spark, sf, "pa").withColumn("daily_cleaned", rounded("daily_cleaned", 6))


@query(_clean_sql("pc"))
def daily_clean_sparse(spark: SparkSession, sf: str) -> DataFrame:
    return _cleaned(spark, sf, "pc").withColumn("daily_cleaned", rounded("daily_cleaned", 6))


@query(f"WITH {panel_sql('pc')}, {clean_sql('pc')} SELECT ts_id, time_d, daily_cleaned FROM pc_c WHERE daily_cleaned IS NULL AND missing_type <> 'missing_short'")
def daily_clean_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Must be empty: a missing value outside the leading gap."""
    return _cleaned(spark, sf, "pc").where("daily_cleaned is null and missing_type <> 'missing_short'").select("ts_id", "time_d", "daily_cleaned")


@query(f"WITH {panel_sql('pc')}, {clean_sql('pc')} SELECT missing_type, count(*) AS n FROM pc_c GROUP BY 1")
def missing_counts_by_obs(spark: SparkSession, sf: str) -> DataFrame:
    return report.counts(clean.with_missing_type(panel(spark, sf, "pc")), "missing_type")


@query(f"WITH {panel_sql('pc')}, {clean_sql('pc')} SELECT ts_id, missing_type, count(*) AS n FROM pc_c GROUP BY 1, 2")
def missing_counts_by_series(spark: SparkSession, sf: str) -> DataFrame:
    return report.counts(clean.with_missing_type(panel(spark, sf, "pc")), "ts_id", "missing_type")


@query(f"WITH {panel_sql('pc')}, {clean_sql('pc')} SELECT missing_type, count(DISTINCT ts_id) AS n, count(DISTINCT ts_id) / (SELECT count(DISTINCT ts_id) FROM pc_c) AS ratio FROM pc_c GROUP BY 1")
def missing_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return report.series_share(clean.with_missing_type(panel(spark, sf, "pc")), "missing_type")


# ---------------------------------------------------------------- holidays

_HOLIDAYS = ", ".join(f"('{h}', {m}, {d}, {'NULL' if p is None else p})" for h, m, d, p in holidays.HOLIDAYS)
HOLIDAY_SQL = f"""{spiked_sql()}, {clean_sql('sp', ', project')},
    h AS (SELECT * FROM (VALUES {_HOLIDAYS}) AS t(holiday, month, day, projects)),
    ap AS (SELECT ts_id, holiday, h.month, h.day FROM (SELECT DISTINCT ts_id, project FROM sp_c) s JOIN h ON projects IS NULL OR list_contains(projects, project)),
    fa AS (SELECT ap.ts_id, ap.holiday, ap.month, ap.day, coalesce(bool_and(outlier = 'outlier'), true) AS every, avg(c.daily_untouched / nullif(c.daily_cleaned, 0)) AS adjustment_factor
        FROM ap LEFT JOIN sp_c c ON c.ts_id = ap.ts_id AND month(c.time_d) = ap.month AND day(c.time_d) = ap.day GROUP BY 1, 2, 3, 4),
    fl AS (SELECT c.ts_id, c.time_d, c.daily_cleaned AS daily_level, coalesce(fa.holiday || CASE WHEN every THEN '_adj' ELSE '_noadj' END, 'regular_day') AS holiday
        FROM sp_c c LEFT JOIN fa ON fa.ts_id = c.ts_id AND fa.month = month(c.time_d) AND fa.day = day(c.time_d))"""


def _spiked_clean(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return clean.daily_clean(spiked(spark, sf)), holidays.holiday_table(spark)


@query(f"WITH {HOLIDAY_SQL} SELECT ts_id, time_d, round(daily_level, 6) AS daily_level, holiday FROM fl")
def holiday_flags(spark: SparkSession, sf: str) -> DataFrame:
    return holidays.flags(*_spiked_clean(spark, sf)).select("ts_id", "time_d", r("daily_level"), "holiday")


@query(f"WITH {HOLIDAY_SQL} SELECT ts_id, holiday, month, day, round(adjustment_factor, 6) AS adjustment_factor FROM fa WHERE every")
def holiday_factors(spark: SparkSession, sf: str) -> DataFrame:
    return holidays.factors(*_spiked_clean(spark, sf)).select("ts_id", "holiday", "month", "day", r("adjustment_factor"))


_MODELS = "mo AS (SELECT ts_id, time_d, lag(daily_cleaned, 7) OVER w AS mod_a, lag(daily_cleaned, 14) OVER w AS mod_b FROM sp_c WINDOW w AS (PARTITION BY ts_id ORDER BY time_d))"


def _reholiday(spark: SparkSession, sf: str, match: str) -> DataFrame:
    cleaned, table = _spiked_clean(spark, sf)
    history, factor = holidays.flags(cleaned, table), holidays.factors(cleaned, table)
    models = history.select("ts_id", "time_d", F.lag("daily_level", 7).over(clean.along()).alias("mod_a"), F.lag("daily_level", 14).over(clean.along()).alias("mod_b"))
    return holidays.reholiday(models, factor, history, ["mod_a", "mod_b"], match).select("ts_id", "time_d", r("mod_a"), r("mod_b"))


@query(f"""WITH {HOLIDAY_SQL}, {_MODELS}, ha AS (SELECT fl.ts_id, fl.time_d, adjustment_factor FROM fl JOIN fa ON fl.ts_id = fa.ts_id AND fl.holiday = fa.holiday || '_adj' AND fa.every)
    SELECT mo.ts_id, mo.time_d, round(mod_a * coalesce(adjustment_factor, 1), 6) AS mod_a, round(mod_b * coalesce(adjustment_factor, 1), 6) AS mod_b
    FROM mo LEFT JOIN ha ON ha.ts_id = mo.ts_id AND ha.time_d = mo.time_d""")
def reholiday(spark: SparkSession, sf: str) -> DataFrame:
    return _reholiday(spark, sf, "date")


@query(f"""WITH {HOLIDAY_SQL}, {_MODELS}
    SELECT mo.ts_id, mo.time_d, round(mod_a * coalesce(adjustment_factor, 1), 6) AS mod_a, round(mod_b * coalesce(adjustment_factor, 1), 6) AS mod_b
    FROM mo LEFT JOIN fa ON every AND fa.ts_id = mo.ts_id AND fa.month = month(mo.time_d) AND fa.day = day(mo.time_d)""")
def reholiday_any_year(spark: SparkSession, sf: str) -> DataFrame:
    return _reholiday(spark, sf, "month_day")


# ---------------------------------------------------------------- growth and weeks


def growth_sql(x: str, lag: int, window: str = "w") -> str:
    one = f"CASE WHEN {x} = 0 THEN 1 ELSE {x} END"
    return f"({one}) / lag({one}, {lag}) OVER {window} - 1"


@query(f"""WITH {panel_sql('pa')}, {clean_sql('pa')} SELECT ts_id, time_d, (isodow(time_d) - 1)::INT AS day_of_week, round({growth_sql('daily_cleaned', 7)}, 6) AS daily_wowGr FROM pa_c {_W}""")
def daily_growth_wow(spark: SparkSession, sf: str) -> DataFrame:
    df = transform.daily_growth(_cleaned(spark, sf, "pa"), "daily_cleaned")
    return df.select("ts_id", "time_d", "day_of_week", r("daily_wowGr"))


def weeks_sql(name: str, source: str, sums: dict[str, str], keys: str = "ts_id") -> str:
    """CTE <name>: sums over whole weeks."""
    lo, hi = f"(SELECT min(time_d) FROM {source})", f"(SELECT max(time_d) FROM {source})"
    inside = f"time_d >= {lo} + ((8 - isodow({lo})) % 7)::INT AND time_d <= {hi} - (isodow({hi}) % 7)::INT"
    return f"{name} AS (SELECT {keys}, CAST(date_trunc('week', time_d) AS DATE) + 6 AS time_w, {', '.join(f'coalesce(sum({a}), 0)::DOUBLE AS {b}' for a, b in sums.items())} FROM {source} WHERE {inside} GROUP BY ALL)"


_WEEKS = weeks_sql("wk", "pb", {"daily_untouched": "weekly_level"})


def _weekly(spark: SparkSession, sf: str, name: str = "pb", value: str = "daily_untouched") -> DataFrame:
    return transform.weekly(panel(spark, sf, name), {value: "weekly_level"})


@query(f"WITH {panel_sql('pb')}, {_WEEKS} SELECT ts_id, time_w, weekly_level FROM wk")
def weekly_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _weekly(spark, sf)


@query(f"WITH {panel_sql('pb')}, {_WEEKS} SELECT ts_id, time_w, round({growth_sql('weekly_level', 1)}, 6) AS weekly_wowGr FROM wk WINDOW w AS (PARTITION BY ts_id ORDER BY time_w)")
def weekly_growth_wow(spark: SparkSession, sf: str) -> DataFrame:
    return transform.weekly_growth(_weekly(spark, sf)).select("ts_id", "time_w", r("weekly_wowGr"))


def _difference(name: str, d: int, seasonal: int, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return transform.differences(panel(spark, sf, "pa"), "daily_untouched", d, seasonal).select("ts_id", "time_d", "diff")

    query(f"WITH {panel_sql('pa')} SELECT ts_id, time_d, {sql} AS diff FROM pa {_W}", name)(run)


def _lag(k: int) -> str:
    return f"lag(daily_untouched, {k}) OVER w"


_difference("difference_d1", 1, 0, f"daily_untouched - {_lag(1)}")
_difference("difference_d0D1", 0, 1, f"daily_untouched - {_lag(7)}")
_difference("difference_d1D1", 1, 1, f"(daily_untouched - {_lag(1)}) - ({_lag(7)} - {_lag(8)})")
_difference("difference_d2", 2, 0, f"(daily_untouched - {_lag(1)}) - ({_lag(1)} - {_lag(2)})")


# ---------------------------------------------------------------- stationarity


def kpss_sql(name: str, source: str, value: str) -> str:
    """CTE <name>_st: ts_id, attempt, stat."""
    v = lambda k: f"lag({value}, {k}) OVER w"
    made = [(0, value, 0), (1, f"{value} - {v(1)}", 1), (2, f"{value} - {v(7)}", 7), (3, f"({value} - {v(1)}) - ({v(7)} - {v(8)})", 8), (4, f"({value} - {v(1)}) - ({v(1)} - {v(2)})", 2)]
    rows = " UNION ALL ".join(f"SELECT ts_id, {k} AS attempt, time_d, {x} AS x, row_number() OVER w AS rn, {cut} AS cut FROM {source} WINDOW w AS (PARTITION BY ts_id ORDER BY time_d)" for k, x, cut in made)
    return f"""{name}_x AS (SELECT ts_id, attempt, time_d, x, row_number() OVER (PARTITION BY ts_id, attempt ORDER BY time_d) AS t FROM ({rows}) WHERE rn > cut),
    {name}_e AS (SELECT ts_id, attempt, t, x - avg(x) OVER (PARTITION BY ts_id, attempt) AS e, count(*) OVER (PARTITION BY ts_id, attempt) AS n, count(x) OVER (PARTITION BY ts_id, attempt) AS m FROM {name}_x),
    {name}_s AS (SELECT *, sum(e) OVER (PARTITION BY ts_id, attempt ORDER BY t) AS s, least(n - 1, ceil(12 * pow(n / 100.0, 0.25)))::INT AS l FROM {name}_e WHERE n = m AND n > 1),
    {name}_g AS (SELECT a.ts_id, a.attempt, sum((1 - k / (a.l + 1.0)) * a.e * b.e) AS g FROM (SELECT *, unnest(range(1, l + 1)) AS k FROM {name}_s) a
        JOIN {name}_s b ON a.ts_id = b.ts_id AND a.attempt = b.attempt AND a.t = b.t + a.k GROUP BY 1, 2),
    {name}_st AS (SELECT f.ts_id, f.attempt, (ss / (n * n)) / nullif((ee + 2 * g.g) / n, 0) AS stat
        FROM (SELECT DISTINCT ts_id, attempt FROM {name}_x) f
        LEFT JOIN (SELECT ts_id, attempt, sum(s * s) AS ss, sum(e * e) AS ee, any_value(n)::DOUBLE AS n FROM {name}_s GROUP BY 1, 2) q USING (ts_id, attempt)
        LEFT JOIN {name}_g g USING (ts_id, attempt))"""


def search_sql(name: str) -> str:
    """CTE <name>_r: ts_id, k (the first attempt that holds)."""
    return f"{name}_r AS (SELECT ts_id, min(CASE WHEN stat < 0.463 THEN attempt END) AS k FROM {name}_st GROUP BY 1)"


_KPSS = f"{panel_sql('pa')}, {clean_sql('pa')}, {kpss_sql('kp', 'pa_c', 'daily_cleaned')}, {search_sql('kp')}"
_LOG = f"{_KPSS}, lg AS (SELECT ts_id, time_d, ln(CASE WHEN daily_cleaned = 0 THEN 1 ELSE daily_cleaned END) AS y FROM pa_c), {kpss_sql('kl', 'lg', 'y')}, {search_sql('kl')}"
_ORDER = (lambda k: f"CASE {k} WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 END", lambda k: f"CASE {k} WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 0 END")
_BOTH = f"""SELECT kp_r.ts_id, (kp_r.k IS NOT NULL OR kl_r.k IS NOT NULL) AS found_stn, CASE WHEN kp_r.k IS NOT NULL THEN 'asis' WHEN kl_r.k IS NOT NULL THEN 'log' END AS func,
    {_ORDER[0]('coalesce(kp_r.k, kl_r.k)')} AS d, {_ORDER[1]('coalesce(kp_r.k, kl_r.k)')} AS seasonal_d, 7 AS S FROM kp_r JOIN kl_r USING (ts_id)"""


@query(f"WITH {_KPSS} SELECT ts_id, attempt, round(stat, 6) AS stat FROM kp_st")
def kpss_statistic(spark: SparkSession, sf: str) -> DataFrame:
    return stationarity.attempts(_cleaned(spark, sf, "pa"), "daily_cleaned", 7).select("ts_id", "attempt", r("stat"))


@query(f"WITH {_KPSS} SELECT ts_id, k IS NOT NULL AS found_stn, {_ORDER[0]('k')} AS d, {_ORDER[1]('k')} AS seasonal_d, 7 AS S FROM kp_r")
def stationarity_search(spark: SparkSession, sf: str) -> DataFrame:
    return stationarity.search(_cleaned(spark, sf, "pa"), "daily_cleaned")


def _searched(spark: SparkSession, sf: str) -> DataFrame:
    return stationarity.search_with_log(_cleaned(spark, sf, "pa"), "daily_cleaned")


@query(f"WITH {_LOG}, b AS ({_BOTH}) SELECT ts_id, found_stn, func, d, seasonal_d, S FROM b")
def stationarity_log(spark: SparkSession, sf: str) -> DataFrame:
    return _searched(spark, sf)


@query(f"WITH {_LOG}, b AS ({_BOTH}) SELECT found_stn, func, d, seasonal_d, count(*) AS n FROM b WHERE func IS NOT NULL GROUP BY ALL")
def stationarity_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return _searched(spark, sf).where("func is not null").groupBy("found_stn", "func", "d", "seasonal_d").agg(F.count("*").alias("n"))


@query(f"""WITH {_LOG}, b AS ({_BOTH}), x AS (SELECT p.ts_id, time_d, found_stn, d, seasonal_d, CASE WHEN func = 'log' THEN ln(CASE WHEN daily_cleaned = 0 THEN 1 ELSE daily_cleaned END) ELSE daily_cleaned END AS y FROM pa_c p JOIN b ON b.ts_id = p.ts_id)
    SELECT ts_id, time_d, round(CASE WHEN NOT found_stn THEN NULL WHEN d = 0 AND seasonal_d = 0 THEN y WHEN d = 1 AND seasonal_d = 0 THEN y - lag(y, 1) OVER w WHEN d = 0 AND seasonal_d = 1 THEN y - lag(y, 7) OVER w
        WHEN d = 1 AND seasonal_d = 1 THEN (y - lag(y, 1) OVER w) - (lag(y, 7) OVER w - lag(y, 8) OVER w) WHEN d = 2 THEN (y - lag(y, 1) OVER w) - (lag(y, 1) OVER w - lag(y, 2) OVER w) END, 6) AS stn FROM x {_W}""")
def stationary_series(spark: SparkSession, sf: str) -> DataFrame:
    """The series in the form that the search found stationary."""
    cleaned = _cleaned(spark, sf, "pa")
    return stationarity.stationary_series(cleaned, _searched(spark, sf), "daily_cleaned").select("ts_id", "time_d", r("stn"))


# ---------------------------------------------------------------- back-transforms by actual growths


_LAST = "(SELECT max(time_d) - 59 FROM pa_c)"


def _sample(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Panel pa with levels and growths, and its last 60 days."""
    full = transform.daily_growth(_cleaned(spark, sf, "pa").withColumn("daily_level", F.col("daily_cleaned")))
    return full, report.last_days(full, 60)


@query(f"""WITH {panel_sql('pa')}, {clean_sql('pa')}, lv AS (SELECT ts_id, time_d, daily_cleaned AS daily_level, {growth_sql('daily_cleaned', 7)} AS g FROM pa_c {_W}),
    va AS (SELECT * FROM lv WHERE time_d >= {_LAST}),
    se AS (SELECT ts_id, isodow(time_d) AS dow, daily_level AS seed FROM lv WHERE time_d < {_LAST} AND time_d >= {_LAST} - 7)
    SELECT va.ts_id, va.time_d, round(seed * product(1 + g) OVER (PARTITION BY va.ts_id, dow ORDER BY va.time_d ROWS UNBOUNDED PRECEDING), 4) AS daily_wowGr_predbt
    FROM va JOIN se ON va.ts_id = se.ts_id AND isodow(va.time_d) = se.dow""")
def growth_to_level_daily(spark: SparkSession, sf: str) -> DataFrame:
    full, last = _sample(spark, sf)
    return backtransform.daily_growth_to_level(last, full).select("ts_id", "time_d", rounded("daily_wowGr_predbt", 4).alias("daily_wowGr_predbt"))


_PA_WEEKS = weeks_sql("wk", "pa_c", {"daily_cleaned": "weekly_level"})
_WG = f"wg AS (SELECT ts_id, time_w, weekly_level, {growth_sql('weekly_level', 1)} AS g FROM wk WINDOW w AS (PARTITION BY ts_id ORDER BY time_w))"


def _week_sample(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    weeks = transform.weekly_growth(transform.weekly(_cleaned(spark, sf, "pa"), {"daily_cleaned": "weekly_level"}))
    start = weeks.agg(F.date_sub(F.max("time_w"), 63).alias("from"))
    return weeks, weeks.join(F.broadcast(start), F.col("time_w") >= F.col("from")).drop("from")


@query(f"""WITH {panel_sql('pa')}, {clean_sql('pa')}, {_PA_WEEKS}, {_WG}, va AS (SELECT * FROM wg WHERE time_w >= (SELECT max(time_w) - 63 FROM wg)),
    se AS (SELECT ts_id, weekly_level AS seed FROM wg WHERE time_w = (SELECT max(time_w) - 70 FROM wg))
    SELECT va.ts_id, time_w, round(seed * product(1 + g) OVER (PARTITION BY va.ts_id ORDER BY time_w ROWS UNBOUNDED PRECEDING), 4) AS weekly_wowGr_predbt FROM va JOIN se USING (ts_id)""")
def growth_to_level_weekly(spark: SparkSession, sf: str) -> DataFrame:
    weeks, last = _week_sample(spark, sf)
    return backtransform.weekly_growth_to_level(last, weeks).select("ts_id", "time_w", rounded("weekly_wowGr_predbt", 4).alias("weekly_wowGr_predbt"))


@query(f"""WITH {panel_sql('pa')}, {clean_sql('pa')}, lv AS (SELECT ts_id, time_d, daily_cleaned AS daily_level, row_number() OVER w AS k, {growth_sql('daily_cleaned', 7)} AS g FROM pa_c {_W})
    SELECT ts_id, time_d, CASE WHEN k > 7 THEN round(first_value(daily_level) OVER v * product(CASE WHEN k <= 7 THEN 1 ELSE 1 + g END) OVER v, 4) END AS daily_wowGr_predbt
    FROM lv WINDOW v AS (PARTITION BY ts_id, isodow(time_d) ORDER BY time_d ROWS UNBOUNDED PRECEDING)""")
def growth_to_level_fitted(spark: SparkSession, sf: str) -> DataFrame:
    full, _ = _sample(spark, sf)
    return backtransform.fitted_growth_to_level(full).select("ts_id", "time_d", rounded("daily_wowGr_predbt", 4).alias("daily_wowGr_predbt"))
