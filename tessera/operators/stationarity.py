"""KPSS tests (Kwiatkowski et al. 1992, level-stationary) by prefix sums, and the search for differencing orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.numeric import one_for_zero

#: Published critical value at 5 %: p > 0.05 exactly where the statistic is below it.
CRITICAL = {0.10: 0.347, 0.05: 0.463, 0.025: 0.574, 0.01: 0.739}
#: Attempts in their order: (d, D).
ATTEMPTS = [(0, 0), (1, 0), (0, 1), (1, 1), (2, 0)]


def kpss(series: DataFrame, keys: tuple[str, ...], value: str, time: str = "time_d", lags: int | None = None) -> DataFrame:
    """keys and stat of every series: NULL if a value is missing or all are equal.

    With prefix sums S of the deviations, the Bartlett-weighted autocovariances up to lag l are the squares of S(t) - S(t - l - 1),
    divided by l + 1, for t from 1 to n + l (S is 0 before the first row and, as sum of all deviations, behind the last). Each
    row gives its S to t and takes it from t + l + 1, so the time is linear in the rows, and all of it keeps a partitioning by keys.
    """
    whole = Window.partitionBy(*keys)
    along = whole.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    own = series.select(*keys, time, F.col(value).cast("double").alias("x"))
    own = own.withColumns({"n": F.count("*").over(whole), "there": F.count("x").over(whole), "mean": F.avg("x").over(whole), "t": F.row_number().over(whole.orderBy(time))})
    own = own.withColumns({"s": F.sum(F.col("x") - F.col("mean")).over(along), "l": F.least(F.col("n") - 1, F.ceil(12 * F.pow(F.col("n") / 100.0, F.lit(0.25)))).cast("int") if lags is None else F.lit(lags)})
    ends = F.array(F.struct(F.col("t").alias("at"), F.col("s").alias("net"), (F.col("s") * F.col("s")).alias("ss")), F.struct((F.col("t") + F.col("l") + 1).alias("at"), (-F.col("s")).alias("net"), F.lit(0.0).alias("ss")))
    steps = own.select(*keys, "n", "l", (F.col("n") == F.col("there")).alias("complete"), F.inline(ends))
    nets = steps.groupBy(*keys, "at").agg(F.sum("net").alias("net"), F.sum("ss").alias("ss"), F.max("n").alias("n"), F.max("l").alias("l"), F.bool_and("complete").alias("complete"))
    sums = nets.groupBy(*keys).agg(F.sum(F.col("net") * F.col("net")).alias("spread"), F.sum("ss").alias("walked"), F.max("n").alias("n"), F.max("l").alias("l"), F.bool_and("complete").alias("complete"))
    stat = F.try_divide(F.col("walked") / (F.col("n") * F.col("n")), F.col("spread") / (F.col("l") + 1) / F.col("n"))
    return sums.select(*keys, F.when(F.col("complete") & (F.col("n") > 1), stat).alias("stat"))


def attempts(df: DataFrame, value: str, season: int) -> DataFrame:
    """ts_id, attempt (place in ATTEMPTS), stat of every differencing; leading rows without a lag are cut off."""
    along = Window.partitionBy("ts_id").orderBy("time_d")
    at = lambda k: F.lag(value, k).over(along)
    x, row = F.col(value), F.row_number().over(along)
    made = [(x, 0), (x - at(1), 1)]
    if season > 1:
        made += [(x - at(season), season), ((x - at(1)) - (at(season) - at(season + 1)), season + 1)]
    made.append(((x - at(1)) - (at(1) - at(2)), 2))
    names = [0, 1, 2, 3, 4] if season > 1 else [0, 1, 4]
    parts = F.array(*[F.struct(F.lit(k).alias("attempt"), d.alias("x"), (row > cut).alias("live")) for k, (d, cut) in zip(names, made, strict=True)])
    each = df.select("ts_id", "time_d", parts.alias("parts")).select("ts_id", "time_d", F.inline("parts")).where("live")
    return kpss(each, ("ts_id", "attempt"), "x")


def search(df: DataFrame, value: str, season: int = 7, threshold: float = 0.05) -> DataFrame:
    """ts_id, found_stn, d, seasonal_d, S: the first attempt that the test doesn't reject."""
    tried = attempts(df, value, season)
    good = F.coalesce(F.col("stat") < CRITICAL[threshold], F.lit(False))
    first = tried.groupBy("ts_id").agg(F.min(F.when(good, F.col("attempt"))).alias("k"))
    order = lambda place: F.get(F.array(*[F.lit(a[place]) for a in ATTEMPTS]), F.col("k"))
    return first.select("ts_id", F.col("k").isNotNull().alias("found_stn"), order(0).alias("d"), order(1).alias("seasonal_d"), F.lit(season).alias("S"))


def search_with_log(df: DataFrame, value: str, season: int = 7, threshold: float = 0.05) -> DataFrame:
    """As search(); series that fail are tried again as logarithms (1 for 0). func: asis, log or NULL."""
    plain = search(df, value, season, threshold)
    logs = search(df.withColumn(value, F.ln(one_for_zero(F.col(value)))), value, season, threshold)
    names = ("found", "diff", "seasonal")
    both = plain.toDF("ts_id", *(f"{n}_asis" for n in names), "S").join(logs.toDF("ts_id", *(f"{n}_log" for n in names), "S_log"), "ts_id")
    pick = lambda n, to: F.when(F.col("found_asis"), F.col(f"{n}_asis")).otherwise(F.col(f"{n}_log")).alias(to)
    func = F.when(F.col("found_asis"), "asis").when(F.col("found_log"), "log").alias("func")
    return both.select("ts_id", (F.col("found_asis") | F.col("found_log")).alias("found_stn"), func, pick("diff", "d"), pick("seasonal", "seasonal_d"), "S")


def stationary_series(df: DataFrame, params: DataFrame, value: str, to: str = "stn") -> DataFrame:
    """ts_id, time_d and the series as the search found it stationary: logarithm and differences by params; NULL where none was."""
    both = df.select("ts_id", "time_d", F.col(value).alias("__x")).join(params.select("ts_id", "found_stn", "func", "d", "seasonal_d", "S"), "ts_id")
    both = both.withColumn("__y", F.when(F.col("func") == "log", F.ln(one_for_zero(F.col("__x")))).otherwise(F.col("__x")))
    along = Window.partitionBy("ts_id").orderBy("time_d")
    y = F.col("__y")
    # lags of two orders, by the seasons that occur in one search: 1 or 7
    at = lambda k: F.lag("__y", k).over(along)
    seasonal = lambda s: {(0, 0): y, (1, 0): y - at(1), (0, 1): y - at(s), (1, 1): (y - at(1)) - (at(s) - at(s + 1)), (2, 0): (y - at(1)) - (at(1) - at(2))}
    pick = F.lit(None).cast("double")
    for s in (1, 7):
        for (d, seasonal_d), x in seasonal(s).items():
            pick = F.when((F.col("S") == s) & (F.col("d") == d) & (F.col("seasonal_d") == seasonal_d), x).otherwise(pick)
    return both.select("ts_id", "time_d", F.when(F.col("found_stn"), pick).alias(to))
