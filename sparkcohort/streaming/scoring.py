"""Structured Streaming over fitted state: extensions, not parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkcohort.operators.joins import lookup


def stream_lookup(stream: DataFrame, state: DataFrame, keys: list[str], default: Column, out: str) -> DataFrame:
    """A stream joined with a static table of fitted state."""
    return lookup(stream, state, keys, default, out)


def windowed_rates(stream: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, end, key, n, mean): tumbling event-time windows with a watermark."""
    marked = stream.withWatermark(time, late)
    out = marked.groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "mean")


def trailing_sums(df: DataFrame, key: str, date: str, value: str, days: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """Adds <value>_<n>d: sums over the n days up to a row's date, within a key."""
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    out = df.withColumn("__day", day)
    for n in days:
        frame = W.partitionBy(key).orderBy("__day").rangeBetween(-(n - 1), 0)
        out = out.withColumn(f"{value}_{n}d", F.sum(value).over(frame))
    return out.drop("__day")
