"""Panels that the queries run on, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.panel import dense

HORIZON = 60
#: Lags in days of the stand-ins for the eight fitted models; all lie beyond the validation sample.
SERIES_LAGS = {"mod_ts_daily_level": 63, "mod_ts_daily_wowGr": 70, "mod_ts_weekly_level": 77, "mod_ts_weekly_wowGr": 84}
TOPLINE_LAGS = {"mod_agg_daily_level": 63, "mod_agg_daily_wowGr": 70, "mod_agg_weekly_level": 77, "mod_agg_weekly_wowGr": 84}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _daily(df: DataFrame, keys: list[str], day: str, level: Column) -> DataFrame:
    """ts_id, time_d, daily_untouched of days that have rows."""
    key = F.concat_ws("_", *[F.col(k).cast("string") for k in keys])
    return df.groupBy(key.alias("ts_id"), F.col(day).cast("date").alias("time_d")).agg(level.cast("double").alias("daily_untouched"))


def sparse_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_shipdate", F.sum("l_quantity"))


def sparse_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_orderdate", F.count("*"))


def sparse_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_shipdate", F.sum("l_quantity"))


def sparse_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(table(spark, sf_dir, "events"), ["event_type"], "ts", F.count("*"))


def sparse_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_shipdate", F.sum("l_quantity"))


SPARSE = {"pa": sparse_a, "pb": sparse_b, "pc": sparse_c, "pd": sparse_d, "pe": sparse_e}


def panel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """ts_id, time_d, daily_untouched over the dense calendar; panel pe also has its group grp."""
    out = dense(SPARSE[name](spark, sf_dir), "daily_untouched")
    return out.withColumn("grp", F.substring_index("ts_id", "_", 2)) if name == "pe" else out


def spiked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Panel pa with 1000 more on every 25th of December, and a project."""
    x = F.when((F.month("time_d") == 12) & (F.day("time_d") == 25), F.coalesce("daily_untouched", F.lit(0.0)) + 1000).otherwise(F.col("daily_untouched"))
    flag = F.substring_index("ts_id", "_", 1)
    project = F.when(flag == "A", "en").when(flag == "N", "fr").otherwise("zh")
    return panel(spark, sf_dir, "pa").withColumns({"daily_untouched": x, "project": project})


# ---------------------------------------------------------------- the same in SQL

_RAW = {
    "pa": "SELECT concat_ws('_', l_returnflag, l_linestatus) AS ts_id, CAST(l_shipdate AS DATE) AS time_d, sum(l_quantity)::DOUBLE AS x FROM lineitem GROUP BY 1, 2",
    "pb": "SELECT concat_ws('_', o_orderpriority, o_orderstatus) AS ts_id, CAST(o_orderdate AS DATE) AS time_d, count(*)::DOUBLE AS x FROM orders GROUP BY 1, 2",
    "pc": "SELECT l_suppkey::VARCHAR AS ts_id, CAST(l_shipdate AS DATE) AS time_d, sum(l_quantity)::DOUBLE AS x FROM lineitem GROUP BY 1, 2",
    "pd": "SELECT event_type AS ts_id, CAST(ts AS DATE) AS time_d, count(*)::DOUBLE AS x FROM events GROUP BY 1, 2",
    "pe": "SELECT concat_ws('_', l_returnflag, l_linestatus, l_linenumber::VARCHAR) AS ts_id, CAST(l_shipdate AS DATE) AS time_d, sum(l_quantity)::DOUBLE AS x FROM lineitem GROUP BY 1, 2",
}


def panel_sql(name: str) -> str:
    """CTEs <name>_raw and <name>."""
    group = ", string_split(s.ts_id, '_')[1] || '_' || string_split(s.ts_id, '_')[2] AS grp" if name == "pe" else ""
    return f"""{name}_raw AS ({_RAW[name]}),
    {name}_days AS (SELECT CAST(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS time_d FROM (SELECT min(time_d) AS lo, max(time_d) AS hi FROM {name}_raw)),
    {name} AS (SELECT s.ts_id, d.time_d, r.x AS daily_untouched{group} FROM (SELECT DISTINCT ts_id FROM {name}_raw) s CROSS JOIN {name}_days d
        LEFT JOIN {name}_raw r ON r.ts_id = s.ts_id AND r.time_d = d.time_d)"""


def spiked_sql() -> str:
    return panel_sql("pa") + """,
    sp AS (SELECT ts_id, time_d, CASE WHEN month(time_d) = 12 AND day(time_d) = 25 THEN coalesce(daily_untouched, 0) + 1000 ELSE daily_untouched END AS daily_untouched,
        CASE string_split(ts_id, '_')[1] WHEN 'A' THEN 'en' WHEN 'N' THEN 'fr' ELSE 'zh' END AS project FROM pa)"""


def clean_sql(name: str, extra: str = "") -> str:
    """CTEs <name>_t, _o, _k, _n, _f and <name>_c (the cleaned panel). extra: further columns of the panel, each with a comma before."""
    return f"""{name}_t AS (SELECT *, CASE WHEN daily_untouched IS NOT NULL THEN 'no_missing'
            WHEN sum((daily_untouched IS NULL)::INT) OVER (PARTITION BY ts_id ORDER BY time_d ROWS UNBOUNDED PRECEDING) = row_number() OVER (PARTITION BY ts_id ORDER BY time_d)
            THEN 'missing_short' ELSE 'missing_hole' END AS missing_type,
            avg(daily_untouched) OVER (PARTITION BY ts_id ORDER BY time_d ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS rm,
            stddev_pop(daily_untouched) OVER (PARTITION BY ts_id) AS sd FROM {name}),
    {name}_o AS (SELECT *, CASE WHEN daily_untouched < rm - 2 * sd OR daily_untouched > rm + 2 * sd THEN 'outlier' ELSE 'ok' END AS outlier FROM {name}_t),
    {name}_k AS (SELECT *, CASE WHEN outlier = 'outlier' THEN NULL ELSE daily_untouched END AS kept FROM {name}_o),
    {name}_n AS (SELECT *, (lag(kept, 7) OVER w + lead(kept, 7) OVER w) / 2 AS nb FROM {name}_k WINDOW w AS (PARTITION BY ts_id ORDER BY time_d)),
    {name}_f AS (SELECT *, CASE WHEN missing_type = 'missing_hole' OR outlier = 'outlier' THEN coalesce(nb, rm) ELSE daily_untouched END AS filled FROM {name}_n),
    {name}_c AS (SELECT ts_id, time_d, daily_untouched, missing_type, outlier{extra}, CASE WHEN v < 0 THEN 0 ELSE v END AS daily_cleaned
        FROM (SELECT *, last_value(filled IGNORE NULLS) OVER (PARTITION BY ts_id ORDER BY time_d ROWS UNBOUNDED PRECEDING) AS v FROM {name}_f))"""
