"""Statistics over measured runs: percentiles by rank, trimmed medians, tests, rolling windows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_percentiles(df: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """keys, p, value: the value at 0-based rank floor((n - 1) * p) of each group.

    Values are counted before they are ranked, so equal ones cost nothing; a hot group's distinct
    values are what one task sorts.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    upto = F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(w))
    p = ranked.withColumn("p", F.explode(F.array(*[F.lit(float(x)) for x in at]))).withColumn("rank", F.floor((F.col("n") - 1) * F.col("p")))
    return p.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c"))).select(*keys, "p", F.col(value).alias("value"))


def trimmed_median(df: DataFrame, keys: list[str], order: list[str], value: str, warmups: int = 3, slowest: float = 0.1) -> DataFrame:
    """keys, median: without the first ``warmups`` and the slowest tenth of each group."""
    runs = df.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__i") > warmups)
    w = Window.partitionBy(*keys)
    runs = runs.withColumn("__r", F.row_number().over(w.orderBy(value, *order))).withColumn("__n", F.count("*").over(w))
    kept = runs.where(F.col("__r") <= F.col("__n") - F.floor(F.col("__n") * slowest))
    return kept.groupBy(*keys).agg(F.median(value).alias("median"))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value)
    mean, dev = F.avg(v), F.stddev_samp(v)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(mean, 6).alias("mean"), F.round(dev, 6).alias("stdev"), F.round(F.stddev_pop(v), 6).alias("stdev_pop"), F.round(dev / mean, 6).alias("cv"))


def erf(x: Column) -> Column:
    """The error function, which Spark lacks; of one row a group, so its cost is small."""

    @F.pandas_udf("double")
    def work(v: pd.Series) -> pd.Series:
        return v.map(math.erf, na_action="ignore")

    return work(x)


def t_test(df: DataFrame, keys: list[str], side: str, value: str, a: str, b: str) -> DataFrame:
    """keys, t, p, significant: two sides of equal size, p = 1 - erf(t / sqrt 2)."""
    on = lambda s, f: f(F.when(F.col(side) == s, F.col(value)))
    g = df.groupBy(*keys).agg(on(a, F.count).alias("n"), on(a, F.avg).alias("ma"), on(b, F.avg).alias("mb"), on(a, F.var_samp).alias("va"), on(b, F.var_samp).alias("vb"))
    t = F.abs(F.col("ma") - F.col("mb")) / F.sqrt((F.col("va") + F.col("vb")) / F.col("n"))
    p = 1 - erf(F.col("t") / math.sqrt(2))
    return g.withColumn("t", t).withColumn("p", p).select(*keys, "t", "p", (F.col("p") <= 0.05).alias("significant"))


def rolling_mean(df: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
    return df.withColumn("rolling", F.avg(value).over(w))


def rolling_time(df: DataFrame, keys: list[str], seconds: Column, value: str, width: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(seconds).rangeBetween(-width, 0)
    return df.withColumn("rolling", F.sum(value).over(w))


def tie_groups(hits: DataFrame, keys: list[str], order: str, score: str, doc: str) -> DataFrame:
    """Hits with equal scores in a row collapsed to one row with their sorted ids."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.coalesce((F.lag(score).over(w) != F.col(score)).cast("int"), F.lit(1))
    g = hits.withColumn("__new", new).withColumn("tie", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy(*keys, "tie").agg(F.first(score).alias(score), F.array_sort(F.collect_list(doc)).alias("docs"))


def settled(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, n, mean, stdev: without the first tenth (1 to 10 rows) and the worst 2 % of each group."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("__i", F.row_number().over(w.orderBy(order))).withColumn("__n", F.count("*").over(w))
    rows = rows.where(F.col("__i") > F.least(F.lit(10), F.greatest(F.lit(1), F.floor(F.col("__n") / 10))))
    rows = rows.withColumn("__r", F.row_number().over(w.orderBy(value, order))).withColumn("__m", F.count("*").over(w))
    kept = rows.where(F.col("__r") <= F.col("__m") - F.floor(F.col("__m") * 0.02))
    return kept.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdev"))


def compare_lists(a: DataFrame, b: DataFrame, query: str, items: str) -> DataFrame:
    """(query, kind): queries whose result lists are missing, extra or different in b."""
    x, y = a.select(query, F.col(items).alias("x")), b.select(query, F.col(items).alias("y"))
    kind = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when(F.col("x") != F.col("y"), "different")
    return x.join(y, query, "full").select(query, kind.alias("kind")).where("kind is not null")
