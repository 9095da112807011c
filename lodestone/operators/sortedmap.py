"""A map in key order on disk, and sets of numbers as bit blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SortedMap:
    """key to value, range partitioned and sorted by key: a lookup, prefix or advance reads the files that can hold it."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows = spark.read.parquet(path)

    @staticmethod
    def build(df: DataFrame, key: str, value: str, path: str) -> SortedMap:
        """Of equal keys the smallest value stays; null keys are left out."""
        own = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(value).alias("value"))
        own.repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)
        return SortedMap(df.sparkSession, path)

    def get(self, key) -> DataFrame:
        return self.rows.where(F.col("key") == key)

    def prefix(self, prefix: str) -> DataFrame:
        return self.rows.where(F.startswith("key", F.lit(prefix)))

    def between(self, low, high) -> DataFrame:
        """Enumeration of the keys from ``low`` on and before ``high``."""
        return self.rows.where((F.col("key") >= low) & (F.col("key") < high))

    def advance(self, key) -> DataFrame:
        """The first entry that is not before ``key``; a heap of one a partition."""
        return self.rows.where(F.col("key") >= key).orderBy("key").limit(1)


def pack_ids(ids: DataFrame, key: str) -> DataFrame:
    """(block, bits): a set of whole numbers, 64 to a block; combined before the shuffle."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(key), F.lit(64)).cast("int"))
    return ids.where(F.col(key).isNotNull()).groupBy(F.floor(F.col(key) / 64).alias("block")).agg(F.bit_or(bit).alias("bits"))


def unpack_ids(blocks: DataFrame) -> DataFrame:
    """(id) of a packed set."""
    bit = lambda i: F.col("bits").bitwiseAND(F.shiftleft(F.lit(1).cast("long"), i)) != 0
    return blocks.select(F.explode(F.filter(F.array(*[F.when(bit(i), F.col("block") * 64 + i) for i in range(64)]), lambda x: x.isNotNull())).alias("id"))


def advance_ids(blocks: DataFrame, at: int) -> DataFrame:
    """(id): the first of a packed set that is ``at`` or more; only one block is unpacked at the end."""
    near = blocks.where(F.col("block") >= at // 64).orderBy("block").limit(2)
    return unpack_ids(near).where(F.col("id") >= at).orderBy("id").limit(1)


def size_of(blocks: DataFrame) -> Column:
    return F.bit_count("bits")
