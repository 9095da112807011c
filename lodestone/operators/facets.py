"""Facets: counts of hits by label, path or range. Every facet is a partial and a final aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flat(hits: DataFrame, label: Column, top: int | None = 10) -> DataFrame:
    """(label, count), largest first; null labels don't count."""
    out = hits.select(label.alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("count"))
    return out.orderBy(F.desc("count"), "label").limit(top) if top else out


def multi_valued(hits: DataFrame, labels: Column, top: int | None = 10) -> DataFrame:
    """As ``flat`` over an array of labels; a label counts once a document."""
    out = hits.select(F.explode(F.array_distinct(labels)).alias("label")).where("label != ''").groupBy("label").agg(F.count("*").alias("count"))
    return out.orderBy(F.desc("count"), "label").limit(top) if top else out


def ranges(hits: DataFrame, column: str, bounds: list[tuple[float, float]]) -> DataFrame:
    """(low, high, count) of half-open ranges, which may overlap; one pass, no shuffle of rows."""
    c = F.col(column)
    sums = hits.agg(*[F.coalesce(F.sum(F.when((c >= a) & (c < b), 1)), F.lit(0)).alias(f"r{i}") for i, (a, b) in enumerate(bounds)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.col(f"r{i}").alias("count")) for i, (a, b) in enumerate(bounds)])).alias("x")).select("x.*")


def rollup_path(hits: DataFrame, levels: list[tuple[str, Column]]) -> DataFrame:
    """Counts of every node of a hierarchy: the levels (null below the node) and count."""
    named = hits.select(*[c.alias(n) for n, c in levels])
    names = [n for n, _ in levels]
    return named.where(F.col(names[0]).isNotNull()).rollup(*names).agg(F.count("*").alias("count"))


def children(hits: DataFrame, path: list[tuple[str, str]], child: str, top: int | None = 10) -> DataFrame:
    """Counts of the children of a path."""
    for column, value in path:
        hits = hits.where(F.col(column) == value)
    return flat(hits, F.col(child), top)


def by_value(hits: DataFrame, value: Column) -> DataFrame:
    """(value, count), ordered by value."""
    return hits.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("count")).orderBy("value")


def drill_sideways(hits: DataFrame, chosen: dict[str, list[str]], dims: list[str]) -> DataFrame:
    """(dim, label, count): each dimension's counts ignore its own choice, but not the others'.

    One pass: a row is exploded to the dimensions that would show it, then counted.
    """
    ok = {d: F.coalesce(F.col(d).isin(*chosen[d]), F.lit(False)) if d in chosen else F.lit(True) for d in dims}
    shown = []
    for d in dims:
        others = F.lit(True)
        for e in dims:
            if e != d:
                others = others & ok[e]
        shown.append(F.when(others & F.col(d).isNotNull(), F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("label"))))
    flat_ = hits.select(F.explode(F.array(*shown)).alias("x")).where("x is not null")
    return flat_.groupBy("x.dim", "x.label").agg(F.count("*").alias("count"))


def character_bucket(n: Column) -> Column:
    """Four levels of buckets, each a tenth as wide as the one above."""
    def level(width: int) -> Column:
        low = F.floor(n / width) * width
        return F.concat(low.cast("string"), F.lit(" - "), (low + width).cast("string"))

    return F.array(*[level(w) for w in (1_000_000, 100_000, 10_000, 1_000)])


def top_labels(labels: DataFrame, top: int) -> DataFrame:
    """(dim, label, count): the most frequent labels of each dimension, from (dim, label) rows."""
    counts = labels.groupBy("dim", "label").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("count"), "label"))
    return counts.withColumn("r", rank).where(F.col("r") <= top).drop("r")


def merge_shards(shards: DataFrame, keys: list[str], top: int, factor: int = 2) -> DataFrame:
    """(keys, label, count): top labels over shards that each send only their ``top * factor`` first.

    Protocol: every shard sends its first labels; the labels sent by any are candidates; for a
    candidate that a shard did not send the shard is asked again, so the counts of candidates are
    whole. ``shards``: keys, shard, label, c (one row each).
    """
    own = Window.partitionBy(*keys, "shard").orderBy(F.desc("c"), "label")
    sent = shards.withColumn("r", F.row_number().over(own)).where(F.col("r") <= top * factor).select(*keys, "label").distinct()
    whole = shards.join(sent, [*keys, "label"], "left_semi").groupBy(*keys, "label").agg(F.sum("c").alias("count"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("count"), "label")) if keys else F.row_number().over(Window.orderBy(F.desc("count"), "label"))
    return whole.withColumn("r", rank).where(F.col("r") <= top).drop("r")
