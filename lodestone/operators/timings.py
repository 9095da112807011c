"""Statistics of measured runs: percentiles by decades, by load, hit summaries, segment timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.stats import rank_percentiles


def decade_percentiles(df: DataFrame, keys: list[str], value: str, decades: int = 6) -> DataFrame:
    """keys, p, value at 0, 0.5, 0.9, 0.99, ... and 1: a decade is shown only where the group has as many values."""
    at = [0.0, 0.5, *[round(1 - 10.0**-i, i) for i in range(1, decades + 1)], 1.0]
    sizes = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("__n"))
    out = rank_percentiles(df, keys, value, at).join(sizes, keys)
    need = F.lit(1)
    for i in range(decades, 0, -1):
        need = F.when(F.col("p") == round(1 - 10.0**-i, i), F.lit(10**i)).otherwise(need)
    return out.where(F.col("__n") >= need).drop("__n")


def load_percentiles(df: DataFrame, second: Column, width: int, value: str, step: int, at: list[float]) -> DataFrame:
    """load, p, value: percentiles of the values by the load (events a bucket of ``width`` seconds, in steps) they ran at."""
    own = df.select(F.floor(second / width).alias("bucket"), F.col(value).alias("value"))
    load = own.groupBy("bucket").agg((F.floor(F.count("*") / step) * step).alias("load"))
    return rank_percentiles(own.join(load, "bucket"), ["load"], "value", at)


def hit_summary(df: DataFrame, keys: list[str], hits: str) -> DataFrame:
    """keys, runs, least, most, same: how many hits the runs of a query and sort had, and whether they agree."""
    return df.groupBy(*keys).agg(F.count("*").alias("runs"), F.min(hits).alias("least"), F.max(hits).alias("most"), (F.min(hits) == F.max(hits)).alias("same"))


def timeline(events: DataFrame, stream: list[str], order: list[str], opens: Column, closes: Column, size: Column) -> DataFrame:
    """The events with the number of segments and of bytes live after each, by stream."""
    w = Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    return events.withColumn("live", F.sum(step).over(w)).withColumn("live_bytes", F.sum(step * size).over(w))


def write_amplification(events: DataFrame, stream: list[str], flushed: Column, merged: Column, size: Column) -> DataFrame:
    """stream, flushed, merged, amplification: all bytes written over the bytes flushed."""
    zero = lambda c: F.coalesce(F.sum(F.when(c, size)), F.lit(0))
    out = events.groupBy(*stream).agg(zero(flushed).alias("flushed"), zero(merged).alias("merged"))
    return out.withColumn("amplification", F.when(F.col("flushed") > 0, (F.col("flushed") + F.col("merged")) / F.col("flushed")))
