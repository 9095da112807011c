"""Streaming queries: each replays a table as a stream to its end and gives the resulting table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import segments
from lodestone.queries.registry import query
from lodestone.streaming import ingest
from lodestone.tables import table


def _events(spark, sf):
    # window functions want a time with a zone; the session's is UTC
    return ingest.replay(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_upsert_latest(spark, sf):
    into = ingest.Versions(spark)
    ingest.upsert(_events(spark, sf).select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"], into)
    return into.read().select("user_id", "event_id", "event_type", "value")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf):
    into = ingest.Versions(spark)
    ingest.keep_updated(ingest.windowed(_events(spark, sf), "ts", "1 day", keys=["event_type"]), ["window", "event_type"], into)
    return into.read().select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("SELECT time_bucket(INTERVAL '6 hours', ts) - s * INTERVAL '6 hours' AS start, count(*) AS n FROM events, range(4) AS r(s) GROUP BY 1")
def sliding_counts(spark, sf):
    into = ingest.Versions(spark)
    ingest.keep_updated(ingest.windowed(_events(spark, sf), "ts", "1 day", "6 hours"), ["window"], into)
    return into.read().select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_counts(spark, sf):
    """Sessions in batch form; in a stream the same window runs with a watermark."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.session_window("ts", "2 hours"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT count(*) AS docs FROM events")
def refresh_count(spark, sf):
    """What a reader of the last snapshot sees after an append-only ingest."""
    into = ingest.Versions(spark)

    def each(batch, number):
        old = into.before(number)
        into.write(batch if old is None else old.unionByName(batch), number)

    ingest.run(_events(spark, sf).select("event_id"), each)
    return into.read().agg(F.count("*").alias("docs"))


@query()
def segment_simulation(spark, sf):
    e = table(spark, sf, "events")
    op = F.when(F.col("event_id") % 50 == 49, "refresh").when(F.col("event_id") % 11 == 3, "del").when(F.col("event_id") % 7 == 5, "update").otherwise("add")
    own = e.select("event_type", op.alias("op"), F.pmod("event_id", F.lit(400)).alias("docid"), (F.abs("value") * 100).cast("long").alias("size_bytes"), "ts", "event_id")
    return segments.simulate(own, "event_type", ["ts", "event_id"], 200_000)
