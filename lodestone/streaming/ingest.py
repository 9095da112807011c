"""Streams: rate-limited ingest, versioned upserts with point-in-time readers, windowed counters.

A sink is a folder of versions. Every micro-batch writes a new version from the last one and the
batch, and its number is the batch's number, so a batch that is repeated after a failure writes
the same version again. Readers take the last whole version and never see a half-written one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.prep import latest
from lodestone.runtime import scratch


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Versions:
    """A table as a folder of whole versions."""

    def __init__(self, spark: SparkSession, path: str | None = None, keep: int = 3):
        self.spark, self.keep = spark, keep
        self.path = path or scratch(spark, "versions")

    def numbers(self) -> list[int]:
        fs, at = _fs(self.spark, self.path)
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        out = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()]
        return sorted(n for n in out if fs.exists(_fs(self.spark, f"{self.path}/v{n}/_SUCCESS")[1]))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The given version, or the last one; None before the first."""
        numbers = self.numbers()
        if not numbers:
            return None
        return self.spark.read.parquet(f"{self.path}/v{numbers[-1] if version is None else version}")

    def before(self, number: int) -> DataFrame | None:
        older = [n for n in self.numbers() if n < number]
        return self.read(older[-1]) if older else None

    def write(self, df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        for old in self.numbers()[: -self.keep]:
            fs, at = _fs(self.spark, f"{self.path}/v{old}")
            fs.delete(at, True)


def replay(spark: SparkSession, path: str, files_per_trigger: int = 1, schema=None) -> DataFrame:
    """A parquet table as a stream, so many files a trigger."""
    schema = schema or spark.read.parquet(path).schema
    fs, at = _fs(spark, path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if fs.getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(path.rsplit("/", 1)[0])


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", every: str | None = None):
    """Start; without ``every`` take what is there and stop."""
    place = scratch(stream.sparkSession, "progress")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", place).foreachBatch(each)
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    if not every:
        query.awaitTermination()
    return query


def upsert(stream: DataFrame, keys: list[str], order: list[str], into: Versions, every: str | None = None):
    """Last writer (by ``order``) wins for every key, across batches and within one."""

    def each(batch: DataFrame, number: int) -> None:
        old = into.before(number)
        both = batch if old is None else old.unionByName(batch)
        into.write(latest(both, keys, order), number)

    return run(stream, each, every=every)


def windowed(stream: DataFrame, ts: str, width: str, slide: str | None = None, keys: list[str] | None = None, late: str = "1 day") -> DataFrame:
    """Counts by tumbling or sliding window; rows later than ``late`` behind the newest are dropped."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(window, *(keys or [])).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, ts: str, gap: str, key: str, late: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def keep_updated(stream: DataFrame, keys: list[str], into: Versions, every: str | None = None):
    """An aggregation in update mode kept as a table: the newest row of each key stays."""

    def each(batch: DataFrame, number: int) -> None:
        fresh = batch.withColumn("__batch", F.lit(number))
        old = into.before(number)
        both = fresh if old is None else old.unionByName(fresh)
        into.write(latest(both, keys, ["__batch"]), number)

    return run(stream, each, mode="update", every=every)
