"""Geographic queries over the pickups of taxi_trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import geo
from lodestone.plans.planner import sampled
from lodestone.queries.analytics import TRIPS, trips
from lodestone.queries.registry import query
from lodestone.tables import table

AT = (40.75, -73.97)
RING = [[(40.70, -74.00), (40.70, -73.92), (40.78, -73.90), (40.80, -73.97)]]
HAV = "2 * 6371008.8 * asin(sqrt(least(1.0, power(sin(radians(40.75 - pickup_latitude) / 2), 2) + cos(radians(pickup_latitude)) * cos(radians(40.75)) * power(sin(radians(-73.97 - pickup_longitude) / 2), 2))))"
OK = "pickup_latitude BETWEEN -90 AND 90 AND pickup_longitude BETWEEN -180 AND 180"


@query(f"WITH {TRIPS} SELECT count(*) AS hits FROM t WHERE pickup_latitude BETWEEN 40.7 AND 40.8 AND pickup_longitude BETWEEN -74.0 AND -73.9")
def box(spark, sf):
    return geo.box(trips(spark, sf), "pickup_latitude", "pickup_longitude", 40.7, 40.8, -74.0, -73.9).agg(F.count("*").alias("hits"))


@query(f"WITH {TRIPS} SELECT trip_id FROM t WHERE {OK} AND {HAV} <= 1500")
def distance(spark, sf):
    return geo.distance(trips(spark, sf), "pickup_latitude", "pickup_longitude", AT, 1500).select("trip_id")


@query(f"WITH {TRIPS} SELECT trip_id, round({HAV}, 3) AS metres FROM t WHERE {OK} ORDER BY metres, trip_id LIMIT 10")
def nearest(spark, sf):
    return geo.nearest(trips(spark, sf), "trip_id", "pickup_latitude", "pickup_longitude", AT, 10)


@query(f"WITH {TRIPS} SELECT trip_id, round({HAV}, 3) AS metres FROM t WHERE pickup_latitude BETWEEN 40.7 AND 40.8 AND pickup_longitude BETWEEN -74.0 AND -73.9 ORDER BY metres, trip_id LIMIT 10")
def distance_sort(spark, sf):
    inside = geo.box(trips(spark, sf), "pickup_latitude", "pickup_longitude", 40.7, 40.8, -74.0, -73.9)
    return geo.nearest(inside, "trip_id", "pickup_latitude", "pickup_longitude", AT, 10)


def _side(a, b) -> str:
    (y1, x1), (y2, x2) = a, b
    return f"CAST((pickup_latitude < {y1}) <> (pickup_latitude < {y2}) AND pickup_longitude < {x1} + (pickup_latitude - {y1}) * {(x2 - x1) / (y2 - y1)} AS INTEGER)" if y1 != y2 else "0"


_IN = " + ".join(_side(a, b) for a, b in zip(RING[0], RING[0][1:] + RING[0][:1]))


@query(f"WITH {TRIPS} SELECT count(*) AS hits FROM t WHERE {OK} AND ({_IN}) % 2 = 1")
def polygon(spark, sf):
    return geo.polygon(trips(spark, sf), "pickup_latitude", "pickup_longitude", RING).agg(F.count("*").alias("hits"))


NGON = geo.regular_polygon(AT, 1500, 50)
_IN_NGON = " + ".join(_side(a, b) for a, b in zip(NGON, NGON[1:] + NGON[:1]))


@query(f"WITH {TRIPS} SELECT count(*) AS hits FROM t WHERE {OK} AND ({_IN_NGON}) % 2 = 1")
def polygon_ngon(spark, sf):
    return geo.polygon(trips(spark, sf), "pickup_latitude", "pickup_longitude", [NGON]).agg(F.count("*").alias("hits"))


@query(f"WITH {TRIPS} SELECT trip_id FROM t WHERE pickup_latitude BETWEEN 40.7 AND 40.8 AND pickup_longitude BETWEEN -74.0 AND -73.9 AND trip_id % 10 = (31 * (trip_id // 10)) % 10")
def box_sampled(spark, sf):
    inside = geo.box(trips(spark, sf), "pickup_latitude", "pickup_longitude", 40.7, 40.8, -74.0, -73.9)
    return inside.where(sampled(F.col("trip_id"), 10)).select("trip_id")


@query()
def shape_relations(spark, sf):
    z = table(spark, sf, "zones").select("place_id", F.try_element_at("rings", F.lit(1)).alias("ring"))
    return geo.shape_relations(z, "place_id", "ring", RING[0])


@query("SELECT CAST(floor((pickup_latitude + 90) / 0.05) AS BIGINT) AS y, CAST(floor((pickup_longitude + 180) / 0.05) AS BIGINT) AS x, count(*) AS n FROM taxi_trips WHERE " + OK + " GROUP BY ALL")
def grid_counts(spark, sf):
    t = table(spark, sf, "taxi_trips").where(F.col("pickup_latitude").between(-90, 90) & F.col("pickup_longitude").between(-180, 180))
    cell = lambda c, base: F.floor((F.col(c) + base) / 0.05)
    return t.groupBy(cell("pickup_latitude", 90).alias("y"), cell("pickup_longitude", 180).alias("x")).agg(F.count("*").alias("n"))
