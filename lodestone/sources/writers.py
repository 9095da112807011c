"""Writers: appends, clustered files, merged segments, and what files take on disk."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_sorted(df: DataFrame, path: str, *columns: str) -> None:
    """Clustered by range: each file holds a stretch, sorted, so that file statistics prune ranges."""
    df.repartitionByRange(*columns).sortWithinPartitions(*columns).write.parquet(path)


def force_merge(spark: SparkSession, path: str, into: str, files: int = 1) -> None:
    """Rewrite into few files; one file is one task's work, so ``files`` should grow with the data."""
    spark.read.parquet(path).coalesce(files).write.parquet(into)


def disk_usage(df: DataFrame) -> DataFrame:
    """(field, bytes, raw_bytes, n_values) of the Parquet files behind a table, largest first.

    Only footers are read, each by the task that got the file's name.
    """
    spark = df.sparkSession
    files = spark.createDataFrame([(f,) for f in df.inputFiles()], "file string")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        for f in frames:
            rows = []
            for name in f["file"]:
                where, path = fs.FileSystem.from_uri(name.replace("file:///", "file:/").replace("file:/", "file:///"))
                meta = pq.ParquetFile(where.open_input_file(path)).metadata
                for g in range(meta.num_row_groups):
                    for c in range(meta.num_columns):
                        col = meta.row_group(g).column(c)
                        rows.append((col.path_in_schema.split(".")[0], col.total_compressed_size, col.total_uncompressed_size, col.num_values))
            yield pd.DataFrame(rows, columns=["field", "b", "r", "n"])

    each = files.repartition(max(1, min(64, len(df.inputFiles())))).mapInPandas(work, "field string, b long, r long, n long")
    return each.groupBy("field").agg(F.sum("b").alias("bytes"), F.sum("r").alias("raw_bytes"), F.sum("n").alias("n_values")).orderBy(F.desc("bytes"), "field")
