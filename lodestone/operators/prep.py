"""Data preparation: shuffles that keep groups, splits, integrity, upserts, merges of feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_groups(df: DataFrame, group: str, within: list[str], seed: int = 1) -> DataFrame:
    """All rows in a random order of groups, the rows of a group together and in order."""
    return df.orderBy(F.xxhash64(F.col(group), F.lit(seed)), group, *within)


def shuffle_rows(df: DataFrame, key: str, seed: int = 1) -> DataFrame:
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def split_groups(df: DataFrame, group: str, percent: int, seed: int = 1) -> DataFrame:
    """``part``: queries for about ``percent`` of the groups, docs for the rest; a group is never split."""
    return df.withColumn("part", F.when(F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(100)) < percent, "queries").otherwise("docs"))


def first_groups(df: DataFrame, group: str, n: int) -> DataFrame:
    """``part`` by the first n groups in order; the distinct groups are what gets ranked."""
    firsts = df.select(group).where(F.col(group).isNotNull()).distinct().orderBy(group).limit(n).withColumn("part", F.lit("queries"))
    return df.join(firsts, group, "left").withColumn("part", F.coalesce("part", F.lit("docs")))


def group_digest(df: DataFrame, group: str, content: list[Column]) -> DataFrame:
    """(group, rows, digest): the digest is the same for any order of the group's rows."""
    return df.groupBy(group).agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*content)).alias("digest"))


def digest_diff(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """Groups that are missing, extra or different in b."""
    a, b = a.select(group, F.col("digest").alias("da"), F.col("rows").alias("ra")), b.select(group, F.col("digest").alias("db"), F.col("rows").alias("rb"))
    kind = F.when(F.col("db").isNull(), "missing").when(F.col("da").isNull(), "extra").when((F.col("da") != F.col("db")) | (F.col("ra") != F.col("rb")), "different")
    return a.join(b, group, "full").select(group, kind.alias("kind")).where("kind is not null")


def sparsity(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, filled, percent), fullest first; one pass."""
    counts = df.agg(F.count("*").alias("__all"), *[F.count(F.when(F.col(c).isNotNull(), 1)).alias(c) for c in columns])
    flat = counts.select("__all", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns])).alias("x"))
    return flat.select("x.field", "x.filled", F.round(100.0 * F.col("x.filled") / F.col("__all"), 4).alias("percent")).orderBy(F.desc("filled"), "field")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last version of each key. Partial maxima first: a hot key leaves one row a task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__v")).select(*keys, "__v.*")


def update_column(df: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` replaced where ``updates`` (unique by key) has a value."""
    return df.join(updates.select(key, F.col(column).alias("__new")), key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def delete_ids(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def merge_feeds(a: DataFrame, b: DataFrame, order: list[str]) -> DataFrame:
    """Two feeds with different columns as one, in order."""
    return a.unionByName(b, allowMissingColumns=True).orderBy(*order)


def lookup(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Each wanted key with its row, or with nulls; found tells which. Equi-join, side chosen by size."""
    return wanted.join(df.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def sized_segments(df: DataFrame, key: str, weights: list[int]) -> DataFrame:
    """``segment`` by contiguous ranges of a dense key, in proportion to the weights."""
    n = df.agg(F.max(key) + 1).first()[0] or 1
    total, at, segment = sum(weights), 0, F.lit(len(weights) - 1)
    bounds = []
    for w in weights:
        at += w
        bounds.append(n * at // total)
    for i in reversed(range(len(weights))):
        segment = F.when(F.col(key) < bounds[i], F.lit(i)).otherwise(segment)
    return df.withColumn("segment", segment)


def dense_ordinal(df: DataFrame, key: str) -> DataFrame:
    """0-based position by key: positions within range partitions plus the partitions' offsets."""
    ranged = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("__p", F.spark_partition_id())
    ranged = ranged.withColumn("__i", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("long"), 33))
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(before.select("__p", "before"), "__p").withColumn("ordinal", F.col("__i") + F.col("before")).drop("__p", "__i", "before")


def repeat(df: DataFrame, times: int) -> DataFrame:
    """Every row so many times, with the number of the repetition; a narrow step."""
    return df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else df.withColumn("round", F.lit(0)).limit(0)


def delete_share(df: DataFrame, key: str, percent: int, seed: int = 1) -> DataFrame:
    """Without about ``percent`` of the keys, always the same ones."""
    return df.where(~chosen(F.col(key), percent, seed))


def chosen(key: Column, percent: float, seed: int = 1) -> Column:
    """About ``percent`` of the keys, by the first 8 digits of a digest that other systems have as well."""
    bound = f"{int(percent / 100 * (1 << 32)):08x}"
    return F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8) < F.lit(bound)


def sortable_hex(n: Column) -> Column:
    """16 digits whose order as text is the order of the whole numbers."""
    return F.lpad(F.lower(F.hex(n.cast("long").bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")
