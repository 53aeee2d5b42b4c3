"""Weekly sums of an event stream: seven-day windows from Monday, closed by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def weekly_stream(events: DataFrame, key: str, time: str = "ts", value: str = "value", late: str = "2 days") -> DataFrame:
    """key, time_w (the week's Sunday), n, total. The epoch began on a Thursday, hence the window's start of four days.

    Windows are cut on the clock that the time column shows: a time without a zone stays without one, whatever the session's is.
    """
    t = F.col(time)
    clock = F.unix_date(t.cast("date")) * F.lit(86_400).cast("long") + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    stamped = events.withColumn("__t", F.timestamp_seconds(clock)).withWatermark("__t", late)
    grouped = stamped.groupBy(F.window("__t", "7 days", "7 days", "4 days").alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    start = F.date_from_unix_date(F.floor(F.unix_seconds("w.start") / 86_400).cast("int"))
    return grouped.select(key, F.date_add(start, 6).alias("time_w"), "n", "total")
