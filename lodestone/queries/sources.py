"""Round trips through file formats: a table is written in the format and read back."""

from __future__ import annotations


from pyspark.sql import functions as F

from lodestone.operators import language
from lodestone.queries.registry import query
from lodestone.runtime import scratch
from lodestone.sources import readers
from lodestone.tables import table


def _place(spark) -> str:
    return scratch(spark, "format")


_DOCS = r"SELECT id, nullif(regexp_replace(any_value(title), '[\t\r\n]+', ' ', 'g'), '') AS title, nullif(regexp_replace(any_value(text), '[\t\r\n]+', ' ', 'g'), '') AS body FROM line_docs WHERE id IS NOT NULL GROUP BY id"


@query(_DOCS)
def source_line_docs(spark, sf):
    path = _place(spark)
    d = table(spark, sf, "line_docs").where("id is not null").dropDuplicates(["id"])
    readers.write_line_docs(d.select("title", F.lit("02-Jan-2020 03:04:05.678").alias("date"), F.col("text").alias("body"), F.col("id").alias("random_label")), path)
    return readers.line_docs(spark, path).select(F.col("random_label").alias("id"), "title", "body")


_RIDE = ["trip_id", "vendor_id", "passenger_count", "trip_distance"]


@query("SELECT CAST(trip_id AS VARCHAR) AS trip_id, cab_color, vendor_id, passenger_count, CASE WHEN isfinite(trip_distance) THEN trip_distance END AS trip_distance FROM taxi_trips")
def source_rides(spark, sf):
    path = _place(spark)
    readers.write_rides(table(spark, sf, "taxi_trips").where("cab_color in ('g', 'y')"), _RIDE, path)
    back = readers.rides(spark, path, {"g": _RIDE, "y": _RIDE})
    d = F.col("trip_distance")
    return back.withColumn("trip_distance", F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)).select("trip_id", "cab_color", "vendor_id", "passenger_count", "trip_distance")


@query()
def language_confusion(spark, sf):
    return language.confusion(table(spark, sf, "documents").where("text is not null"), "lang", "text")
