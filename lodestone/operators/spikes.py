"""Implausible measurements, per source.

The readings of a source, in the order of its own running number and on the scale of its median
and deviation, fill a profile matrix: a row is a working day of ``WIDTH`` successive readings.
Robust principal components (principal component pursuit by augmented Lagrange multipliers) split
the matrix into a low-rank part, the source's normal behaviour, and a sparse part. A reading's
score is its sparse part over the residual's own median size in that source; what scores more than
``SCORE`` is a candidate, and nothing else is looked at again. Candidates are then measured exactly
against median and deviation. Impossible values and constant runs are tested separately.

Sources with up to ``LIGHT_ROWS`` readings are worked on whole. Larger ones are cut into blocks of
successive numbers; their medians come from mergeable histograms, and runs that reach a block's
border are joined from the blocks' border summaries.

Defined results: a null value is no case and interrupts a run; a null trip_id gives no row; rows
with equal trip_id count once. Without a source only impossible values are cases; without a
number a reading belongs to no run. A source of one reading has deviation 0, so the floor holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.runtime import group_codes, materialise, whole_groups

WIDTH = 8
#: A candidate's score, the deviations that make a case of it, and how far out readings tell no more.
SCORE, LIMIT, FAR = 6.0, 12.0, 48.0
RUN = 8
LIGHT_ROWS = 20_000
BLOCK = 4096
ITERATIONS = 12
#: Weight of the sparse part, of the usual 1 / sqrt(longer side): profile matrices are small, and a
#: spike must not pass for a component of its own.
SPARSE_WEIGHT = 0.6

#: field: (floor of the deviation, smallest possible value, largest, tested for runs, histogram step)
FIELDS = {
    "trip_distance": (0.05, 0.0, np.inf, True, 0.001),
    "passenger_count": (0.4, 0.0, np.inf, False, 0.5),
    "pickup_latitude": (0.002, -90.0, 90.0, True, 0.0001),
}


def exact_median(df: DataFrame, keys: list[str], value: str, step: float | Column) -> DataFrame:
    """keys, median: exact for groups of any size (mean of the middle two if their number is even).

    Counts per histogram step are merged map-side; a group's steps are bounded by a constant, and
    only the values of the one or two steps that hold the middle ranks are looked at again.
    """
    bound = float(1 << 22)
    step_no = F.greatest(F.least(F.floor(F.col(value) / (step if isinstance(step, Column) else F.lit(step))).cast("double"), F.lit(bound)), F.lit(-bound)).cast("long")
    df = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"), step_no.alias("__b"))
    counts = df.groupBy(*keys, "__b").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*keys)
    counts = counts.withColumn("upto", F.sum("n").over(group.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(group))
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    middle = counts.where((F.col("upto") > low) & (F.col("upto") - F.col("n") <= high)).select(*keys, "__b", (F.col("upto") - F.col("n")).alias("before"), "all")
    near = df.join(middle, [*keys, "__b"]).groupBy(*keys, "__b", "before", "all", "__v").agg(F.count("*").alias("n"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("upto", upto).where((F.col("upto") > low) & (F.col("upto") - F.col("n") <= high))
    return near.groupBy(*keys).agg(((F.min("__v") + F.max("__v")) / 2).alias("median"))


def robust_pca(rows: np.ndarray, group: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Low-rank part of many matrices at once (principal component pursuit).

    ``rows`` holds the rows of all matrices, ``group`` (ascending) the matrix of each. The singular
    value thresholding is done on the small Gram matrices; the penalty grows by half a step, so
    that low-rank and sparse part add up to the matrix at the end.
    """
    if not len(rows):
        return rows
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    height = np.diff(np.r_[first, len(rows)])
    at = np.repeat(np.arange(len(first)), height)
    weight = SPARSE_WEIGHT / np.sqrt(np.maximum(height, rows.shape[1]))
    spread = lambda x: x[at][:, None]

    def gram(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[:, :, None] * x[:, None, :], first, axis=0)

    norm = np.sqrt(np.maximum(np.linalg.eigvalsh(gram(rows))[:, -1], 1e-18))
    dual = rows / spread(np.maximum(norm, np.maximum.reduceat(np.abs(rows).max(1), first) / weight))
    mu = 1.25 / norm
    sparse, low = np.zeros_like(rows), rows.copy()
    for _ in range(iterations):
        x = rows - sparse + dual / spread(mu)
        values, vectors = np.linalg.eigh(gram(x))
        sigma = np.sqrt(np.maximum(values, 1e-18))
        keep = np.maximum(0.0, 1.0 - 1.0 / (mu[:, None] * sigma))
        project = np.einsum("gij,gj,gkj->gik", vectors, keep, vectors)
        low = np.einsum("ri,rij->rj", x, project[at])
        rest = rows - low + dual / spread(mu)
        sparse = np.sign(rest) * np.maximum(np.abs(rest) - spread(weight / mu), 0.0)
        dual = dual + spread(mu) * (rows - low - sparse)
        mu = mu * 1.5
    return low


def spikes(value: np.ndarray, group: np.ndarray, median: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Mask of the readings off their source's median by more than ``LIMIT`` scales.

    ``group`` ascends; ``median`` and ``scale`` are given per row, NaN for sources without any.
    """
    hit = np.zeros(len(value), bool)
    use = np.flatnonzero(np.isfinite(value) & np.isfinite(median) & np.isfinite(scale))
    if not len(use):
        return hit
    v, g, m, s = value[use], group[use], median[use], scale[use]
    with np.errstate(over="ignore"):
        z = np.clip((v - m) / s, -FAR, FAR)
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    size = np.diff(np.r_[first, len(g)])
    place = np.arange(len(g)) - np.repeat(first, size)
    rows = -(-size // WIDTH)
    base = np.cumsum(rows) - rows
    matrix = np.zeros((rows.sum(), WIDTH))
    at = np.repeat(base, size) + place // WIDTH, place % WIDTH
    matrix[at] = z
    low = robust_pca(matrix, np.repeat(np.arange(len(rows)), rows))
    # fewer working days than a day has readings show no behaviour but median and scale
    short = rows < WIDTH
    low[np.repeat(short, rows)] = 0.0
    sparse = np.abs(z - low[at])
    # the residual's usual size; readings vary by about one scale, so it is taken as one at least
    source = np.repeat(np.arange(len(size)), size)
    usual = np.where(short, 1.0, np.maximum(1.0, group_median(sparse, source, len(size))))[source]
    candidate = np.flatnonzero(sparse > SCORE * usual)
    with np.errstate(over="ignore"):
        hit[use[candidate]] = np.abs(v[candidate] - m[candidate]) > LIMIT * s[candidate]
    return hit


def group_median(value: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Median of the finite values of each group 0..n-1; NaN for a group without any."""
    ok = np.isfinite(value)
    v, g = value[ok], group[ok]
    order = np.lexsort((v, g))
    v = v[order]
    size = np.bincount(g, minlength=n)
    first = np.cumsum(size) - size
    out = np.full(n, np.nan)
    some = size > 0
    a, b = v[(first + (size - 1) // 2)[some]], v[(first + size // 2)[some]]
    out[some] = (a + b) / 2
    return out


def runs(value: np.ndarray, group: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run number, run length) per row; rows that are not usable stand alone with length 0."""
    same = np.zeros(len(value), bool)
    same[1:] = usable[1:] & usable[:-1] & (value[1:] == value[:-1]) & (group[1:] == group[:-1])
    number = np.cumsum(~same) - 1
    length = np.bincount(number)[number] if len(value) else np.zeros(0, int)
    return number, np.where(usable, length, 0)


OUT = "trip_id long, field_name string, border string, source string, block long, side int, value double, length long"


def _detect(table: pa.Table, keys: list[str], given: bool) -> Iterator[pa.RecordBatch]:
    """Cases of whole sources or whole blocks; blocks also give their border runs for joining."""
    group = group_codes(table, keys)
    n = int(group[-1]) + 1
    trip = table.column("trip_id").to_numpy()
    sourced = table.column("source").is_valid().to_numpy()
    seq_ok = table.column("trip_seq").is_valid().to_numpy() & sourced
    for name, (floor, least, most, with_runs, _) in FIELDS.items():
        col = table.column(name)
        there = col.is_valid().to_numpy()
        value = col.to_numpy().astype(float)
        finite = there & np.isfinite(value)
        with np.errstate(invalid="ignore"):
            bad = there & (~np.isfinite(value) | (value < least) | (value > most))
        usable = np.where(finite & sourced, value, np.nan)
        if given:
            median, mad = table.column(f"{name}__median").to_numpy().astype(float), table.column(f"{name}__mad").to_numpy().astype(float)
        else:
            median = group_median(usable, group, n)[group]
            mad = group_median(np.abs(usable - median), group, n)[group]
        hit = bad | spikes(usable, group, median, np.maximum(mad, floor))
        border = np.zeros(len(value), bool)
        if with_runs:
            ok = finite & seq_ok
            number, length = runs(value, group, ok)
            hit |= length >= RUN
            if given:
                # rows without a number come first and are no part of a block's order
                rank = np.where(seq_ok, group, -1)
                head = np.r_[True, rank[1:] != rank[:-1]] & seq_ok
                tail = np.r_[rank[1:] != rank[:-1], True] & seq_ok
                first_run, last_run = np.unique(number[head]), np.unique(number[tail])
                is_first, is_last = np.isin(number, first_run) & seq_ok, np.isin(number, last_run) & seq_ok
                border = is_first | is_last
                rows = np.flatnonzero(border)
                # a long run's rows are cases already; one row stands for it at the border
                start = np.r_[True, number[1:] != number[:-1]]
                rows = rows[(length[rows] < RUN) | start[rows]]
                side = np.where(is_first & is_last, 0, np.where(is_first, 1, 2))[rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(trip[rows]), pa.array([name] * len(rows), pa.string()), pa.array(["y"] * len(rows), pa.string()), table.column("source").combine_chunks().take(pa.array(rows)) if not isinstance(table.column("source").combine_chunks(), pa.ChunkedArray) else pa.concat_arrays(table.column("source").take(pa.array(rows)).chunks),
                     table.column("block").take(pa.array(rows)).combine_chunks() if not isinstance(table.column("block").take(pa.array(rows)).combine_chunks(), pa.ChunkedArray) else pa.concat_arrays(table.column("block").take(pa.array(rows)).chunks),
                     pa.array(side, pa.int32()), pa.array(np.where(ok[rows], value[rows], np.nan)), pa.array(length[rows], pa.int64())],
                    names=["trip_id", "field_name", "border", "source", "block", "side", "value", "length"])
        rows = np.flatnonzero(hit)
        none = lambda kind: pa.nulls(len(rows), kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(trip[rows]), pa.array([name] * len(rows), pa.string()), none(pa.string()), none(pa.string()), none(pa.int64()), none(pa.int32()), none(pa.float64()), none(pa.int64())],
            names=["trip_id", "field_name", "border", "source", "block", "side", "value", "length"])


def _over(keys: list[str], given: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys, least=20_000):
            yield from _detect(table, keys, given)

    return work


def find_spikes(trips: DataFrame) -> DataFrame:
    """(trip_id, field_name) of every reading that cannot be right."""
    own = trips.select("trip_id", F.col("meter_id").alias("source"), F.col("trip_seq").cast("long").alias("trip_seq"), *[F.col(f).cast("double").alias(f) for f in FIELDS])
    own = materialise(own.where("trip_id is not null").dropDuplicates(["trip_id"]))
    # how many sources can be heavy is bounded by the rows over LIGHT_ROWS
    heavy = own.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") > LIGHT_ROWS).select("source").where("source is not null")
    light = own.join(heavy, "source", "left_anti").where("source is not null")
    light = light.repartition("source").sortWithinPartitions("source", "trip_seq", "trip_id").mapInArrow(_over(["source"], False), OUT)
    stray = own.where("source is null").mapInArrow(_over(["source"], False), OUT)
    large = own.join(heavy, "source")
    scales = _scales(large)
    blocks = large.withColumn("block", F.floor(F.col("trip_seq") / BLOCK)).withColumn("block", F.coalesce("block", -1 - F.pmod("trip_id", F.lit(64))))
    blocks = blocks.join(scales, "source", "left").repartition("source", "block").sortWithinPartitions("source", "block", "trip_seq", "trip_id")
    found = blocks.mapInArrow(_over(["source", "block"], True), OUT)
    found = materialise(found)
    cases = light.unionByName(stray).unionByName(found).where("border is null").select("trip_id", "field_name")
    return cases.unionByName(_joined_runs(found.where("border = 'y'"))).distinct()


def _scales(rows: DataFrame) -> DataFrame:
    """source, then median and mad of every field over the source's finite values; two passes for all fields."""
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    readings = F.array(*[F.struct(F.lit(name).alias("field"), finite(name).alias("v"), F.lit(step).alias("step")) for name, (*_, step) in FIELDS.items()])
    flat = rows.select("source", F.explode(readings).alias("r")).select("source", "r.*").where("v is not null")
    keys = ["source", "field"]
    median = exact_median(flat, keys, "v", F.col("step"))
    off = flat.join(median, keys).select(*keys, "step", F.abs(F.col("v") - F.col("median")).alias("v"))
    both = median.join(exact_median(off, keys, "v", F.col("step")).withColumnRenamed("median", "mad"), keys)
    one = lambda c, name: F.max(F.when(F.col("field") == name, F.col(c))).alias(f"{name}__{c}")
    return both.groupBy("source").agg(*[one(c, name) for name in FIELDS for c in ("median", "mad")])


def _joined_runs(border: DataFrame) -> DataFrame:
    """Cases of runs that reach over blocks, from the runs at the blocks' borders.

    A block gives its first run (side 1) and its last (2), or the one run it consists of (0); the
    window sees these summaries only.
    """
    at = ["source", "field_name", "block", "side"]
    pieces = border.groupBy(*at).agg(F.max("length").alias("length"), F.first("value").alias("value"))
    w = Window.partitionBy("source", "field_name").orderBy("block", "side")
    before = lambda c: F.lag(c).over(w)
    goes_on = (F.col("side") != 2) & (F.col("length") > 0) & (before("length") > 0) & (before("value") == F.col("value"))
    pieces = pieces.withColumn("new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    pieces = pieces.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    long_ = pieces.groupBy("source", "field_name", "run").agg(F.sum("length").alias("total"), F.count("*").alias("parts")).where((F.col("total") >= RUN) & (F.col("parts") > 1))
    hit = pieces.join(long_, ["source", "field_name", "run"]).select(*at)
    return border.join(hit, at).select("trip_id", "field_name")
