"""The queries of the general problems: p2 (drift), p4 (spikes), p5 (places), p6 (instants)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import drift, instants, spatial, spikes
from lodestone.tables import table


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """All datetime texts; rows with equal trip_id or id count once, a null id names no row."""
    trips = table(spark, sf, "taxi_trips").select("trip_id", "feed_id", "received_at", "pickup_datetime", "dropoff_datetime")
    trips = trips.where("trip_id is not null").dropDuplicates(["trip_id"])
    docs = table(spark, sf, "line_docs").select("id", "feed_id", "received_at", "timestamp_raw")
    docs = docs.where("id is not null").dropDuplicates(["id"])
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("pickup_datetime", "dropoff_datetime")])).alias("f")
    a = trips.select(F.lit("taxi_trips").alias("table_name"), F.col("trip_id").cast("string").alias("row_key"), "feed_id", "received_at", fields)
    a = a.select("table_name", "row_key", "f.field_name", "feed_id", "received_at", "f.text")
    b = docs.select(F.lit("line_docs").alias("table_name"), F.col("id").alias("row_key"), F.lit("timestamp_raw").alias("field_name"), "feed_id", "received_at", F.col("timestamp_raw").alias("text"))
    return a.unionByName(b)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return instants.resolve_instants(_texts(spark, sf), table(spark, sf, "feeds")).select("table_name", "row_key", "field_name", "utc_us")


def p6_inferred_order(spark: SparkSession, sf: str) -> DataFrame:
    """How often the record order alone, without the feeds' declaration, finds the declared instant."""
    texts, feeds = _texts(spark, sf), table(spark, sf, "feeds")
    key = ["table_name", "row_key", "field_name"]
    told = instants.resolve_instants(texts, feeds).select(*key, F.col("utc_us").alias("told"))
    own = instants.resolve_instants(texts, feeds, declared=False).select(*key, "fmt", "utc_us")
    both = own.join(told, key)
    return both.groupBy("table_name", F.pmod("fmt", F.lit(100)).alias("format_no")).agg(F.count("*").alias("texts"), F.sum((F.col("told") == F.col("utc_us")).cast("long")).alias("agreeing"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.changes(table(spark, sf, "knn_result_raw"))


def p2_lifespans(spark: SparkSession, sf: str) -> DataFrame:
    return drift.lifespans(table(spark, sf, "knn_result_raw"))


def p2_table(spark: SparkSession, sf: str) -> DataFrame:
    return drift.one_table(table(spark, sf, "knn_result_raw"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return spikes.find_spikes(table(spark, sf, "taxi_trips"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    trips = table(spark, sf, "taxi_trips").select("trip_id", "pickup_latitude", "pickup_longitude", "dropoff_latitude", "dropoff_longitude")
    once = trips.where("trip_id is not null").dropDuplicates(["trip_id"])
    ends = F.explode(F.array(*[F.struct(F.lit(e).alias("trip_end"), F.col(f"{e}_latitude").alias("lat"), F.col(f"{e}_longitude").alias("lon")) for e in ("pickup", "dropoff")])).alias("p")
    points = once.select("trip_id", ends).select("trip_id", "p.trip_end", "p.lat", "p.lon")
    regions = spatial.regions(stands=table(spark, sf, "stands"), zones=table(spark, sf, "zones"))
    # the raw rows are as good a sample for the layout and cost no shuffle
    layout = trips.select(F.explode(F.array(F.struct(F.col("pickup_latitude").alias("lat"), F.col("pickup_longitude").alias("lon")), F.struct(F.col("dropoff_latitude").alias("lat"), F.col("dropoff_longitude").alias("lon")))).alias("p")).select("p.lat", "p.lon")
    return spatial.match_regions(points, regions, ["trip_id", "trip_end"], layout)


def p5_near(spark: SparkSession, sf: str) -> DataFrame:
    """How many pickups lie within 10 m of the pickup of every trip whose id is divisible by 100, by the partitioned way; the pairs themselves grow with the density."""
    trips = table(spark, sf, "taxi_trips").select("trip_id", F.col("pickup_latitude").alias("lat"), F.col("pickup_longitude").alias("lon"))
    once = trips.where("trip_id is not null").dropDuplicates(["trip_id"])
    asked = once.where("trip_id % 100 = 0")
    near = spatial.near_points(once, asked, "trip_id", 10.0, trips).groupBy("trip_id").agg(F.count("*").alias("near"))
    return asked.select("trip_id").join(near, "trip_id", "left").select("trip_id", F.coalesce("near", F.lit(0)).alias("near"))


QUERIES = {f.__name__: f for f in (p2_found, p2_lifespans, p2_table, p4_found, p5_found, p5_near, p6_found, p6_inferred_order)}

_TRIPS = "t AS (SELECT trip_id, any_value(meter_id) AS m, any_value(trip_seq) AS s, any_value(trip_distance) AS d, any_value(passenger_count) AS p, any_value(pickup_latitude) AS l FROM taxi_trips WHERE trip_id IS NOT NULL GROUP BY trip_id)"
P4 = f"""
WITH {_TRIPS}, u AS (
  SELECT trip_id, m, s, 'trip_distance' AS f, CAST(d AS DOUBLE) AS v, 0.05 AS floor_, 0.0 AS low, CAST('Infinity' AS DOUBLE) AS high, true AS runs FROM t
  UNION ALL SELECT trip_id, m, s, 'passenger_count', CAST(p AS DOUBLE), 0.4, 0.0, CAST('Infinity' AS DOUBLE), false FROM t
  UNION ALL SELECT trip_id, m, s, 'pickup_latitude', CAST(l AS DOUBLE), 0.002, -90.0, 90.0, true FROM t),
c AS (SELECT m, f, median(v) AS med FROM u WHERE m IS NOT NULL AND isfinite(v) GROUP BY m, f),
g AS (SELECT u.m, u.f, any_value(c.med) AS med, median(abs(u.v - c.med)) AS mad FROM u JOIN c ON u.m = c.m AND u.f = c.f WHERE isfinite(u.v) GROUP BY u.m, u.f),
o AS (SELECT *, isfinite(v) AS ok, row_number() OVER w AS n, lag(v) OVER w AS before FROM u WHERE runs AND m IS NOT NULL AND s IS NOT NULL WINDOW w AS (PARTITION BY m, f ORDER BY s, trip_id)),
r AS (SELECT *, sum(CASE WHEN ok AND before IS NOT NULL AND isfinite(before) AND v = before THEN 0 ELSE 1 END) OVER (PARTITION BY m, f ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM o),
k AS (SELECT m, f, run FROM r WHERE coalesce(ok, false) GROUP BY m, f, run HAVING count(*) >= 8)
SELECT trip_id, f AS field_name FROM u WHERE v IS NOT NULL AND (NOT isfinite(v) OR v < low OR v > high)
UNION SELECT trip_id, u.f FROM u JOIN g ON u.m = g.m AND u.f = g.f WHERE isfinite(v) AND abs(v - med) > 12 * greatest(mad, floor_)
UNION SELECT trip_id, r.f FROM r JOIN k ON r.m = k.m AND r.f = k.f AND r.run = k.run WHERE coalesce(ok, false)
"""
P5 = """
WITH t AS (SELECT trip_id, any_value(pickup_latitude) AS a, any_value(pickup_longitude) AS b, any_value(dropoff_latitude) AS c, any_value(dropoff_longitude) AS d FROM taxi_trips WHERE trip_id IS NOT NULL GROUP BY trip_id),
p0 AS (SELECT trip_id, 'pickup' AS trip_end, a AS lat, b AS lon FROM t UNION ALL SELECT trip_id, 'dropoff', c, d FROM t),
p AS (SELECT * FROM p0 WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT isnan(lat) AND NOT isnan(lon)),
s AS (SELECT trip_id, trip_end, place_id FROM p, stands WHERE 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - latitude) / 2), 2) + cos(radians(lat)) * cos(radians(latitude)) * pow(sin(radians(lon - longitude) / 2), 2)))) <= radius_m),
r AS (SELECT place_id, unnest(rings) AS ring FROM zones),
e AS (SELECT place_id, ring[i].latitude AS y1, ring[i].longitude AS x1, ring[i % len(ring) + 1].latitude AS y2, ring[i % len(ring) + 1].longitude AS x2 FROM (SELECT place_id, ring, unnest(range(1, len(ring) + 1)) AS i FROM r)),
z AS (SELECT trip_id, trip_end, place_id FROM p, e WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY trip_id, trip_end, place_id HAVING count(*) % 2 = 1)
SELECT * FROM s UNION ALL SELECT * FROM z
"""
P5_NEAR = """
WITH p AS (SELECT DISTINCT trip_id, pickup_latitude AS lat, pickup_longitude AS lon FROM taxi_trips WHERE trip_id IS NOT NULL AND pickup_latitude BETWEEN -90 AND 90 AND pickup_longitude BETWEEN -180 AND 180 AND NOT isnan(pickup_latitude) AND NOT isnan(pickup_longitude)),
q AS (SELECT trip_id AS a, lat AS y, lon AS x FROM p WHERE trip_id % 100 = 0)
SELECT w.trip_id, coalesce(c.near, 0) AS near FROM (SELECT DISTINCT trip_id FROM taxi_trips WHERE trip_id % 100 = 0) w LEFT JOIN (SELECT a, count(*) AS near FROM q, p WHERE a <> trip_id AND abs(lat - y) < 0.001 AND 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - y) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * pow(sin(radians(lon - x) / 2), 2)))) <= 10 GROUP BY a) c ON c.a = w.trip_id
"""
_P2 = """
r AS (SELECT DISTINCT suite_id, file_id, file_seq, record_no, run_key, payload FROM knn_result_raw WHERE file_id IS NOT NULL AND suite_id IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'),
f AS (SELECT *, dense_rank() OVER (PARTITION BY suite_id ORDER BY file_seq, file_id) AS no FROM (SELECT DISTINCT suite_id, file_id, file_seq FROM r)),
k AS (SELECT suite_id, file_id, run_key, payload, unnest(json_keys(payload)) AS key FROM r),
v0 AS (SELECT suite_id, file_id, run_key, key, json_extract(payload, '$."' || key || '"') AS v FROM k),
v AS (SELECT *, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS t FROM v0),
d AS (SELECT suite_id, no, file_id, key, coalesce(list_sort(list(DISTINCT t) FILTER (WHERE t IS NOT NULL)), []) AS types FROM v JOIN f USING (suite_id, file_id) GROUP BY ALL)
"""
P2 = f"""
WITH {_P2},
come AS (SELECT f.file_id, f.suite_id, f.no, d.key FROM f JOIN d USING (suite_id, no) WHERE f.no > 1 AND NOT EXISTS (SELECT 1 FROM d b WHERE b.suite_id = f.suite_id AND b.no = f.no - 1 AND b.key = d.key)),
gone AS (SELECT f.file_id, b.file_id AS before, f.suite_id, f.no, b.key FROM f JOIN d b ON b.suite_id = f.suite_id AND b.no = f.no - 1 WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.suite_id = f.suite_id AND d.no = f.no AND d.key = b.key)),
type AS (SELECT a.file_id, a.key FROM d a JOIN d b ON a.suite_id = b.suite_id AND a.no = b.no + 1 AND a.key = b.key WHERE len(a.types) > 0 AND len(b.types) > 0 AND a.types <> b.types),
val AS (SELECT file_id, key, run_key, count(DISTINCT (t, x)) AS n, any_value(t) AS t, any_value(x) AS x FROM (SELECT file_id, key, run_key, t, CASE WHEN t = 'number' THEN CAST(CAST(v AS DOUBLE) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS x FROM v WHERE t IS NOT NULL AND run_key IS NOT NULL) GROUP BY ALL),
pair AS (SELECT g.file_id, g.key AS lost, c.key AS new FROM gone g JOIN come c ON c.file_id = g.file_id JOIN val a ON a.file_id = g.before AND a.key = g.key JOIN val b ON b.file_id = c.file_id AND b.key = c.key AND b.run_key = a.run_key
  GROUP BY ALL HAVING bool_and(a.n = 1 AND b.n = 1 AND a.t = b.t AND a.x = b.x) AND count(DISTINCT a.t) = 1)
SELECT file_id, key AS field_name, 'added' AS change_kind FROM come WHERE (file_id, key) NOT IN (SELECT file_id, new FROM pair)
UNION ALL SELECT file_id, key, 'removed' FROM gone WHERE (file_id, key) NOT IN (SELECT file_id, lost FROM pair)
UNION ALL SELECT DISTINCT file_id, new, 'renamed' FROM pair
UNION ALL SELECT file_id, key, 'retyped' FROM type
"""
P2_LIFESPANS = f"""
WITH {_P2},
s AS (SELECT *, CASE WHEN lag(no) OVER w = no - 1 AND lag(types) OVER w = types THEN 0 ELSE 1 END AS begins FROM d WINDOW w AS (PARTITION BY suite_id, key ORDER BY no)),
i AS (SELECT *, sum(begins) OVER (PARTITION BY suite_id, key ORDER BY no ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT suite_id, key AS field_name, array_to_string(any_value(types), '|') AS json_types, arg_min(file_id, no) AS first_file, arg_max(file_id, no) AS last_file, max(no) - min(no) + 1 AS files FROM i GROUP BY suite_id, key, island
"""
SQL: dict[str, str] = {"p2_found": P2, "p2_lifespans": P2_LIFESPANS, "p4_found": P4, "p5_found": P5, "p5_near": P5_NEAR}
