"""Mixed timestamp texts to UTC instants.

Every text gets the array of all its valid interpretations (slash dates both ways round, both
instants of a local time that occurs twice). A Viterbi pass over each source's record order then
picks one interpretation per record. The hidden state is the order in which the source writes its
slash dates. A reading pays for contradicting the source's declaration, for another order than the
state's, and for a jump in time against the record order: a record stands at the time it was
received, a reading behind that is one backward, and one long before it is less likely than one
just before. A change of state pays as well, so dates that have one valid reading tell how those
around them are meant.

The difference of the two states' costs passes through a record as ``clip(d) + x``, and so through
any stretch of records as one clipped shift of three numbers. Each stretch is summed up in parallel,
the summaries (a row per ``CHUNK`` records) are chained from both sides, and every stretch is then
decoded from exact border states: the result does not depend on how the records are partitioned.

Defined results: null, empty and blank texts, texts that name no moment, dates or times of day
that do not exist, unknown zone abbreviations, and local times of a source without a known zone
give no row. White space around a text is ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zoneinfo import available_timezones

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import materialise

# White space of Unicode, month names, zone abbreviations in minutes east of UTC.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　﻿"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "JST": 540, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420,
}

# Formats by number; the pattern admits the text, the parts are cut out afterwards.
ISO, COMPACT, DAY_MONTH_NAME, MONTH_NAME_FIRST, SLASH, MAIL, EPOCH = range(1, 8)
PATTERNS = {
    ISO: r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?: ?(?:[A-Za-z]{1,5}|[+-]\d{2}:?\d{2})(?:\[[^\]]+\])?)?$",
    COMPACT: r"^\d{8}T\d{6}(?:[A-Za-z]{1,5}|[+-]\d{2}:?\d{2})?$",
    DAY_MONTH_NAME: r"^\d{1,2}-[A-Za-z]{3}-\d{4} \d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,9})?$",
    MONTH_NAME_FIRST: r"^[A-Za-z]{3} {1,2}\d{1,2} \d{4} {1,2}\d{1,2}:\d{2}(?::\d{2})? ?(?:[AaPp][Mm])?$",
    SLASH: r"^\d{1,2}/\d{1,2}/\d{4} {1,2}\d{1,2}:\d{2}(?::\d{2})?(?: ?[AaPp][Mm])?$",
    MAIL: r"^[A-Za-z]{3}, \d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{2}:\d{2} (?:[A-Za-z]{1,5}|[+-]\d{4})$",
    EPOCH: r"^(?:\d{10}|\d{13}|\d{16})$",
}

#: Cost of an interpretation that the source's declaration or the rule for repeated times excludes.
AGAINST_DECLARATION = 1e9
#: Costs: of a change of order; of a reading behind its receipt and of one before it, by log(1 + days).
SWITCH, BACKWARD, LATE = 4.0, 2.0, 0.5
#: Records of a stretch that is summed up and decoded at a time.
CHUNK = 100_000


def _int(text: Column) -> Column:
    return F.when(F.length(text) > 0, text.cast("int")).otherwise(F.lit(0))


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01, null where there is no such date."""
    zero = F.lit(0)
    stamp = F.try_make_timestamp_ntz(year, month, day, zero, zero, F.lit(0).cast("decimal(16,6)"))
    return F.unix_date(stamp.cast("date")).cast("long")


def with_interpretations(df: DataFrame, text: str, tz: str, order: str, declared: bool = True) -> DataFrame:
    """Add ``__cand``: array<struct<fmt int, utc_us long, cost double>> of the text's readings, and
    ``__open``: whether it is a slash date whose order the source does not declare.

    ``tz`` and ``order`` (``MDY`` or ``DMY``, null: not declared) name columns of ``df``. Without
    ``declared`` the order column carries no weight and the record order has to decide.
    """
    t = F.col("__t")
    kind = F.lit(None).cast("int")
    for number, pattern in reversed(PATTERNS.items()):
        kind = F.when(t.rlike(pattern), F.lit(number)).otherwise(kind)
    df = df.withColumn("__t", F.btrim(F.col(text), F.lit(WHITE))).withColumn("__k", F.when(F.length("__t") >= 10, kind))
    k = F.col("__k")

    iso = lambda start, n: F.substring(t, start, n)
    at = lambda parts, i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    zone = F.regexp_extract(t, r"([A-Za-z]{1,5}|[+-]\d{2}:?\d{2})(?:\[[^\]]+\])?$", 1)
    empty = F.lit("")
    split = F.when(
        k.isin(DAY_MONTH_NAME, MONTH_NAME_FIRST, SLASH, MAIL),
        F.split(F.regexp_replace(t, r"(\d)([AaPp][Mm])$", "$1 $2"), r"[/,:. ]+|(?<=[0-9A-Za-z])-(?=[0-9A-Za-z])"),
    )
    df = df.withColumn("__s", split)
    s = F.col("__s")
    clock = lambda i: [at(s, i), at(s, i + 1)]
    third = at(s, 6)
    third_is_mark = third.rlike("^[AaPp][Mm]$")
    # year, month, day, hour, minute, second, fraction, am/pm mark, zone
    parts = (
        F.when(k == ISO, F.array(iso(1, 4), iso(6, 2), iso(9, 2), iso(12, 2), iso(15, 2), iso(18, 2), F.regexp_extract(F.substring(t, 20, 10), r"^[.,](\d+)", 1), empty, F.when(F.length(t) > 19, F.regexp_extract(F.substring(t, 20, 99), r"([A-Za-z]{1,5}|[+-]\d{2}:?\d{2})(?:\[[^\]]+\])?$", 1)).otherwise(empty)))
        .when(k == COMPACT, F.array(iso(1, 4), iso(5, 2), iso(7, 2), iso(10, 2), iso(12, 2), iso(14, 2), empty, empty, F.when(F.length(t) > 15, F.substring(t, 16, 9)).otherwise(empty)))
        .when(k == DAY_MONTH_NAME, F.array(at(s, 3), at(s, 2), at(s, 1), *clock(4), at(s, 6), at(s, 7), empty, empty))
        .when(k == MONTH_NAME_FIRST, F.array(at(s, 3), at(s, 1), at(s, 2), *clock(4), F.when(third_is_mark, empty).otherwise(third), empty, F.when(third_is_mark, third).otherwise(at(s, 7)), empty))
        .when(k == SLASH, F.array(at(s, 3), at(s, 1), at(s, 2), *clock(4), F.when(third_is_mark, empty).otherwise(third), empty, F.when(third_is_mark, third).otherwise(at(s, 7)), empty))
        .when(k == MAIL, F.array(at(s, 4), at(s, 3), at(s, 2), at(s, 5), at(s, 6), at(s, 7), empty, empty, zone))
    )
    df = df.withColumn("__p", parts)
    p = lambda i: F.element_at("__p", i)
    named = F.instr(F.lit(MONTHS), F.lower(p(2)))
    month = F.when(k.isin(DAY_MONTH_NAME, MONTH_NAME_FIRST, MAIL), F.when((named > 0) & (F.pmod(named, F.lit(3)) == 1), ((named + 2) / 3).cast("int"))).otherwise(_int(p(2)))
    hour, minute, second = _int(p(4)), _int(p(5)), _int(p(6))
    mark = F.upper(p(8))
    hour24 = F.when(mark == "", F.when(hour < 24, hour)).when((hour >= 1) & (hour <= 12), F.pmod(hour, F.lit(12)) + F.when(mark == "PM", 12).otherwise(0))
    micros = _int(F.rpad(F.substring(p(7), 1, 6), 6, "0"))
    tod = F.when((minute < 60) & (second < 60), ((hour24 * 60 + minute) * 60 + second).cast("long") * 1_000_000 + micros)
    sign = F.when(F.startswith(p(9), F.lit("-")), -1).otherwise(1)
    digits = F.regexp_replace(p(9), r"\D", "")
    off_minute = _int(F.substring(digits, 3, 2))
    offset = (
        F.when(p(9) == "", F.lit(None).cast("int"))
        .when(p(9).rlike("^[+-]"), F.when((off_minute < 60) & (_int(F.substring(digits, 1, 2)) <= 18), sign * (_int(F.substring(digits, 1, 2)) * 60 + off_minute)))
        .otherwise(F.try_element_at(F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv]), F.upper(p(9))))
    )
    year, day = _int(p(1)), _int(p(3))
    df = (
        df.withColumn("__tod", tod)
        .withColumn("__off", offset)
        .withColumn("__zoned", p(9) != "")
        .withColumn("__d1", _days(year, month, day))
        .withColumn("__d2", F.when((k == SLASH) & (day <= 12), _days(year, day, month)))
    )

    def readings(days: str, fmt: Column, cost: Column) -> Column:
        local = F.col(days) * 86_400_000_000 + F.col("__tod")
        first = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), F.col(tz)))
        # if clocks go back soon after, by whatever amount, the same local time may come again
        soon = first + 3 * 3_600_000_000
        again = local - (F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(soon), F.col(tz))) - soon)
        twice = F.when(again > first, F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(again), F.col(tz))) == local).otherwise(False)
        read = lambda us, more: F.struct(fmt.cast("int").alias("fmt"), us.alias("utc_us"), (cost + more).cast("double").alias("cost"))
        later = AGAINST_DECLARATION if declared else 0.25
        return (
            F.when(local.isNull(), F.array().cast("array<struct<fmt:int,utc_us:bigint,cost:double>>"))
            .when(F.col("__zoned"), F.when(F.col("__off").isNotNull(), F.array(read(local - F.col("__off").cast("long") * 60_000_000, F.lit(0.0)))))
            .when(F.col(tz).isNotNull(), F.when(twice, F.array(read(first, F.lit(0.0)), read(again, F.lit(later)))).otherwise(F.array(read(first, F.lit(0.0)))))
        )

    digits10 = t.cast("long") * F.when(F.length(t) == 10, 1_000_000).when(F.length(t) == 13, 1000).otherwise(1)
    weight = F.lit(AGAINST_DECLARATION if declared else 0.0)
    o = F.upper(F.col(order))
    against = lambda mine: F.when(o == mine, weight).otherwise(0.0)
    none = F.array().cast("array<struct<fmt:int,utc_us:bigint,cost:double>>")
    cand = (
        F.when(k == EPOCH, F.array(F.struct(k.alias("fmt"), digits10.alias("utc_us"), F.lit(0.0).alias("cost"))))
        .when(k == SLASH, F.concat(F.coalesce(readings("__d1", k, against("DMY")), none), F.coalesce(readings("__d2", F.lit(SLASH + 100), against("MDY")), none)))
        .when(k.isNotNull(), readings("__d1", k, F.lit(0.0)))
    )
    # A reading the declaration excludes is no reading if nothing else is left: such a date does not exist.
    df = df.withColumn("__cand", F.coalesce(cand, none))
    kept = F.when(F.exists("__cand", lambda c: c["cost"] < AGAINST_DECLARATION), F.col("__cand")).otherwise(none)
    undeclared = F.lit(True) if not declared else ~F.coalesce(o.isin("MDY", "DMY"), F.lit(False))
    return df.withColumn("__cand", kept).withColumn("__open", F.coalesce((k == SLASH) & undeclared, F.lit(False))).drop("__t", "__k", "__s", "__p", "__tod", "__off", "__zoned", "__d1", "__d2")


class Stretch:
    """The records of a table in order: what each state makes of them."""

    def __init__(self, table: pa.Table):
        cand = table.column("__cand").combine_chunks()
        cand = cand.chunk(0) if isinstance(cand, pa.ChunkedArray) else cand
        self.start = cand.offsets.to_numpy().astype(np.int64)
        self.start -= self.start[0]
        flat = cand.flatten()
        self.fmt, self.us, cost = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("fmt", "utc_us", "cost"))
        self.seq = table.column("__seq").to_numpy()
        size = np.diff(self.start)
        self.live = np.flatnonzero(size > 0)
        received = table.column("received_us").to_numpy(zero_copy_only=False).astype(float)
        with np.errstate(invalid="ignore"):
            ahead = (self.us - np.repeat(received, size)) / 86_400e6
        jump = np.where(ahead > 0, BACKWARD, LATE) * np.log1p(np.abs(np.nan_to_num(ahead)))
        jump[self.fmt % 100 != SLASH] = 0.0
        base = cost + jump
        # the best reading and its cost under each state (0: month first, 1: day first)
        self.best, self.cost = [], []
        first = self.start[:-1][self.live]
        for other in (SLASH + 100, SLASH):
            c = base + SWITCH * (self.fmt == other)
            low = np.minimum.reduceat(c, first) if len(first) else np.zeros(0)
            at = np.flatnonzero(c == np.repeat(low, size[self.live]))
            owner = np.repeat(np.arange(len(self.live)), size[self.live])[at]
            self.best.append(at[np.searchsorted(owner, np.arange(len(self.live)))])
            self.cost.append(low)
        x = self.cost[0] - self.cost[1] if len(self.live) else np.zeros(0)
        open_ = table.column("__open").to_numpy(zero_copy_only=False)[self.live]
        self.telling = np.flatnonzero(open_)
        self.x = x[self.telling]

    def runs(self) -> Iterator[tuple[int, int, int]]:
        """(sequence, from, to) of the telling records of each sequence."""
        seq = self.seq[self.live[self.telling]]
        cuts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1], True]) if len(seq) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield int(seq[a]), a, b

    def summary(self, a: int, b: int) -> tuple[float, ...]:
        """Shift and bounds of the difference of costs from left to right and from right to left."""
        c, low, high = 0.0, -np.inf, np.inf
        back, least, most = 0.0, -np.inf, np.inf
        for x in self.x[a:b].tolist():
            c, low, high = c + x, min(max(low, -SWITCH), SWITCH) + x, min(max(high, -SWITCH), SWITCH) + x
            least, most = min(max(back - SWITCH, least), most), min(max(back + SWITCH, least), most)
            back += x
        return c, low, high, back, least, most

    def states(self, a: int, b: int, before: float, after: float) -> np.ndarray:
        """The state of each telling record, given the difference of costs on both sides."""
        x = self.x[a:b].tolist()
        left, right = np.zeros(b - a), np.zeros(b - a)
        d = before
        for i, v in enumerate(x):
            d = min(max(d, -SWITCH), SWITCH) + v
            left[i] = d
        d = after
        for i in range(b - a - 1, -1, -1):
            right[i] = d
            d = min(max(d + x[i], -SWITCH), SWITCH)
        return (left + right > 0).astype(int)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A task's records in tables of ``CHUNK``; where they are cut depends on the files only."""
    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, CHUNK - rows)
            held.append(part)
            rows += part.num_rows
            batch = batch.slice(part.num_rows)
            if rows == CHUNK:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


SUMMARY = "seq long, pos long, c double, low double, high double, back double, least double, most double"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    for table in _stretches(batches):
        part, pos = Stretch(table), int(table.column("pos")[0].as_py())
        rows = [(seq, pos, *part.summary(a, b)) for seq, a, b in part.runs()]
        if rows:
            kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def chain(summaries: list) -> dict[tuple[int, int], tuple[float, float]]:
    """(sequence, stretch): the difference of costs before and after it."""
    out: dict[tuple[int, int], list[float]] = {}
    order = sorted(summaries, key=lambda r: (r["seq"], r["pos"]))
    for rows, side in ((order, 0), (order[::-1], 1)):
        seq, d = None, 0.0
        for r in rows:
            if r["seq"] != seq:
                seq, d = r["seq"], 0.0
            out.setdefault((seq, r["pos"]), [0.0, 0.0])[side] = d
            c, low, high = (r["c"], r["low"], r["high"]) if not side else (r["back"], r["least"], r["most"])
            d = min(max(d + c, low), high)
    return {k: (a, b) for k, (a, b) in out.items()}


def _decode(borders):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = borders.value
        for table in _stretches(batches):
            part, pos = Stretch(table), int(table.column("pos")[0].as_py())
            if not len(part.live):
                continue
            # where the order is declared or nothing is open, both states read the same
            chosen = part.best[0].copy()
            for seq, a, b in part.runs():
                state = part.states(a, b, *known.get((seq, pos), (0.0, 0.0)))
                at = part.telling[a:b]
                chosen[at] = np.where(state == 1, part.best[1][at], part.best[0][at])
            out = table.select(["table_name", "row_key", "field_name"]).take(pa.array(part.live))
            out = out.append_column("fmt", pa.array(part.fmt[chosen], pa.int32())).append_column("utc_us", pa.array(part.us[chosen], pa.int64()))
            yield from out.combine_chunks().to_batches()

    return work


def known_zones(feeds: DataFrame) -> DataFrame:
    """feed_id, tz_name, slash_order, one row a feed; a zone that is none becomes null."""

    @F.pandas_udf("string")
    def known(names: pd.Series) -> pd.Series:
        zones = available_timezones()
        return names.map(lambda x: x if x in zones else None)

    return feeds.select("feed_id", known("tz_name").alias("tz_name"), "slash_order").where("feed_id is not null").dropDuplicates(["feed_id"])


def resolve_instants(texts: DataFrame, feeds: DataFrame, declared: bool = True) -> DataFrame:
    """The one UTC instant of each text: (table_name, row_key, field_name, fmt, utc_us).

    ``texts``: table_name, row_key, field_name, feed_id, received_at, text; one row a text. The
    records of a source (table, field, feed) are decoded in the order received. A range
    partitioning cuts hot sources into as many tasks as they need, and border states go from one
    to the next.
    """
    zones = known_zones(feeds)
    known = texts.where(F.length("text") > 0).join(zones, "feed_id", "left")
    ordered = known.repartitionByRange("table_name", "field_name", "feed_id", "received_at", "row_key")
    ordered = ordered.sortWithinPartitions("table_name", "field_name", "feed_id", "received_at", "row_key")
    read = with_interpretations(ordered, "text", "tz_name", "slash_order", declared)
    seq = F.xxhash64("table_name", "field_name", "feed_id").alias("__seq")
    received = F.unix_micros(F.col("received_at").cast("timestamp")).alias("received_us")
    # no filter here: pushed down, it would bring a copy of all the expressions above with it
    read = materialise(read.select("table_name", "row_key", "field_name", seq, received, "__cand", "__open", F.monotonically_increasing_id().alias("pos")))
    spark = texts.sparkSession
    borders: dict = {}
    if read.where("__open").limit(1).count():
        borders = chain(read.select("__seq", "received_us", "__cand", "__open", "pos").mapInArrow(_summaries, SUMMARY).collect())
    return read.mapInArrow(_decode(spark.sparkContext.broadcast(borders)), "table_name string, row_key string, field_name string, fmt int, utc_us long")
