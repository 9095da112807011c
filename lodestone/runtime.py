"""Session-level helpers shared by the operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def machine_local(spark: SparkSession) -> bool:
    """Whether the driver is the only machine there is."""
    return spark.sparkContext.master.startswith("local")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir`` that every executor can reach.

    Only a session on one machine may do without that setting and gets a folder of its own, which
    goes when the driver ends; on a cluster such a folder would lose data, so there it is an error.
    """
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not machine_local(spark):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
            atexit.register(shutil.rmtree, _OWN[app].removeprefix("file://"), ignore_errors=True)
        got = _OWN[app]
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        if path.startswith(("file:", "/")):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, whose files go when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read, not a re-computation, and lets
    several branches of a plan start from one result. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, "table")
    df.write.parquet(path)
    return spark.read.parquet(path)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[pa.Table]:
    """Cut a stream of batches, sorted by ``keys``, into tables that hold whole groups only.

    A table has at least ``least`` rows where the input has; the rows of the last, perhaps
    unfinished, group wait for the next batch.
    """
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.concat_tables(held)
        cut = _last_start(table, keys)
        if cut:
            yield table.slice(0, cut).combine_chunks()
        held, rows = [table.slice(cut)], table.num_rows - cut
    if rows:
        yield pa.concat_tables(held).combine_chunks()


def _last_start(table: pa.Table, keys: list[str]) -> int:
    """Row at which the last group of a sorted table begins; found by bisection."""
    last = [table.column(k)[-1] for k in keys]
    low, high = 0, table.num_rows - 1
    while low < high:
        mid = (low + high) // 2
        if all(table.column(k)[mid].equals(v) for k, v in zip(keys, last)):
            high = mid
        else:
            low = mid + 1
    return low


def group_codes(table: pa.Table, keys: list[str]):
    """0-based running number of each row's group in a table sorted by ``keys``."""
    import numpy as np
    import pyarrow.compute as pc

    change = np.zeros(table.num_rows, dtype=bool)
    for k in keys:
        col = table.column(k)
        col = (col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col).dictionary_encode()
        col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
        codes = pc.fill_null(col.indices, -1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(change)
