"""Facets, joins and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import facets, prep, stats
from lodestone.plans import dsl, planner
from lodestone.queries.registry import query
from lodestone.queries.text import D, docs, has
from lodestone.tables import table


def _h(spark, sf):
    return planner.hits(docs(spark, sf), dsl.classic("segment"))


H = f"WITH {D}, h AS (SELECT * FROM d WHERE {has('segment')}) "
TRIPS = "t AS (SELECT trip_id, any_value(meter_id) AS meter_id, any_value(trip_seq) AS trip_seq, any_value(cab_color) AS cab_color, any_value(passenger_count) AS passenger_count, any_value(trip_distance) AS trip_distance, any_value(total_amount) AS total_amount, any_value(tip_amount) AS tip_amount, any_value(payment_type) AS payment_type, any_value(pickup_latitude) AS pickup_latitude, any_value(pickup_longitude) AS pickup_longitude FROM taxi_trips WHERE trip_id IS NOT NULL GROUP BY trip_id)"


def trips(spark, sf):
    cols = ["trip_id", "meter_id", "trip_seq", "cab_color", "passenger_count", "trip_distance", "total_amount", "tip_amount", "payment_type", "pickup_latitude", "pickup_longitude"]
    return table(spark, sf, "taxi_trips").select(*cols).where("trip_id is not null").dropDuplicates(["trip_id"])


@query(H + "SELECT lang AS label, count(*) AS count FROM h WHERE lang IS NOT NULL GROUP BY lang ORDER BY count DESC, label LIMIT 10")
def facet_flat(spark, sf):
    return facets.flat(_h(spark, sf), F.col("lang"))


@query("WITH p AS (SELECT id, any_value(categories) AS c FROM line_docs WHERE id IS NOT NULL GROUP BY id) SELECT label, count(*) AS count FROM (SELECT unnest(list_distinct(string_split(c, '|'))) AS label FROM p WHERE c IS NOT NULL) WHERE label <> '' GROUP BY label ORDER BY count DESC, label LIMIT 10")
def facet_multi_valued(spark, sf):
    p = table(spark, sf, "line_docs").select("id", "categories").where("id is not null").dropDuplicates(["id"])
    return facets.multi_valued(p, F.split("categories", r"\|"))


@query(H + "SELECT low, high, (SELECT count(*) FROM h WHERE n_chars >= low AND n_chars < high) AS count FROM (VALUES (0, 500), (500, 1000), (0, 2000)) AS r(low, high)")
def facet_range_halfopen(spark, sf):
    return facets.ranges(_h(spark, sf), "n_chars", [(0, 500), (500, 1000), (0, 2000)])


@query(H + "SELECT CAST(year(updated_at) AS INTEGER) AS y, CAST(month(updated_at) AS INTEGER) AS m, CAST(day(updated_at) AS INTEGER) AS d, count(*) AS count FROM h WHERE updated_at IS NOT NULL GROUP BY ROLLUP (y, m, d)")
def facet_date_rollup(spark, sf):
    at = F.col("updated_at")
    return facets.rollup_path(_h(spark, sf), [("y", F.year(at)), ("m", F.month(at)), ("d", F.dayofmonth(at))])


@query(H + "SELECT strftime(updated_at, '%B') AS label, count(*) AS count FROM h WHERE updated_at IS NOT NULL GROUP BY 1")
def facet_month(spark, sf):
    return facets.flat(_h(spark, sf), F.date_format("updated_at", "MMMM"), None)


@query("SELECT n_name AS label, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region) GROUP BY n_name ORDER BY count DESC, label LIMIT 10")
def facet_hier_children(spark, sf):
    region = table(spark, sf, "region")
    first = region.agg(F.min("r_name")).first()[0]
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return facets.children(c, [("r_name", first)], "n_name")


@query("SELECT r_name, n_name, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def facet_hier_all(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return facets.rollup_path(c, [("r_name", F.col("r_name")), ("n_name", F.col("n_name"))])


@query(f"WITH {TRIPS} SELECT passenger_count AS value, count(*) AS count FROM t WHERE passenger_count IS NOT NULL GROUP BY 1 ORDER BY 1")
def facet_value_sorted(spark, sf):
    return facets.by_value(trips(spark, sf), F.col("passenger_count"))


@query(H + "SELECT source AS label, count(*) AS count FROM h WHERE lang IN ('en', 'de') AND source IS NOT NULL GROUP BY source ORDER BY count DESC, label LIMIT 10")
def drill_down(spark, sf):
    line = "DrillDown: segment +drillDown:lang=en,de +facets:taxonomy:source"
    return facets.flat(planner.hits(docs(spark, sf), dsl.parse(line).query), F.col("source"))


@query(H + "SELECT 'lang' AS dim, lang AS label, count(*) AS count FROM h WHERE source = 'wiki_pages' AND lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM h WHERE lang IN ('en', 'de') AND source IS NOT NULL GROUP BY source")
def drill_sideways(spark, sf):
    return facets.drill_sideways(_h(spark, sf), {"lang": ["en", "de"], "source": ["wiki_pages"]}, ["lang", "source"])


_BUCKET = "SELECT level, CAST((n_chars // width) * width AS VARCHAR) || ' - ' || CAST((n_chars // width) * width + width AS VARCHAR) AS label, count(*) AS count FROM h, (VALUES (1, 1000000), (2, 100000), (3, 10000), (4, 1000)) AS b(level, width) WHERE n_chars IS NOT NULL GROUP BY 1, 2"


@query(H + _BUCKET)
def char_count_hierarchy(spark, sf):
    h = _h(spark, sf).where("n_chars is not null").select(F.posexplode(facets.character_bucket(F.col("n_chars"))).alias("level", "label"))
    return h.groupBy((F.col("level") + 1).alias("level"), "label").agg(F.count("*").alias("count"))


@query("SELECT count(DISTINCT username) AS distinct_values, count(username) AS filled FROM documents")
def unique_terms(spark, sf):
    return table(spark, sf, "documents").agg(F.count_distinct("username").alias("distinct_values"), F.count("username").alias("filled"))


@query("SELECT username, dense_rank() OVER (ORDER BY username) - 1 AS ordinal FROM (SELECT DISTINCT username FROM documents WHERE username IS NOT NULL)")
def ordinal_map(spark, sf):
    return prep.dense_ordinal(table(spark, sf, "documents").select("username").where("username is not null").distinct(), "username")


# ---- joins
@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def pk_lookup_hit(spark, sf):
    wanted = table(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return prep.lookup(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), wanted, "o_orderkey").where("found").drop("found")


@query("SELECT DISTINCT w.k AS o_orderkey FROM (SELECT CASE WHEN l_linenumber = 1 THEN -l_orderkey - 1 ELSE l_orderkey END AS k FROM lineitem WHERE l_quantity = 50) w LEFT JOIN orders ON o_orderkey = w.k WHERE o_orderkey IS NULL")
def pk_lookup_miss(spark, sf):
    k = F.when(F.col("l_linenumber") == 1, -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey"))
    wanted = table(spark, sf, "lineitem").where("l_quantity = 50").select(k.alias("o_orderkey")).distinct()
    return prep.lookup(table(spark, sf, "orders").select("o_orderkey"), wanted, "o_orderkey").where("not found").select("o_orderkey")


@query("SELECT trip_id, cab_color, pickup_datetime, CASE WHEN cab_color = 'g' THEN trip_type END AS trip_type FROM taxi_trips WHERE cab_color IN ('g', 'y') ORDER BY received_at, trip_id LIMIT 500")
def merge_two_streams(spark, sf):
    """The first 500 rows of the merge, as the SQL says; the whole is merge_two_streams_all."""
    return _merged(spark, sf).limit(500).drop("received_at")


@query("SELECT trip_id, cab_color, pickup_datetime, CASE WHEN cab_color = 'g' THEN trip_type END AS trip_type, received_at FROM taxi_trips WHERE cab_color IN ('g', 'y')")
def merge_two_streams_all(spark, sf):
    """The whole merge with its order columns received_at, trip_id."""
    return _merged(spark, sf)


def _merged(spark, sf):
    t = table(spark, sf, "taxi_trips")
    green = t.where("cab_color = 'g'").select("trip_id", "cab_color", "pickup_datetime", "trip_type", "received_at")
    # the yellow feed knows no trip type
    yellow = t.where("cab_color = 'y'").select("trip_id", "cab_color", "pickup_datetime", "received_at")
    return prep.merge_feeds(green, yellow, ["received_at", "trip_id"])


@query("SELECT event_type AS label, sum(c) AS count FROM (SELECT event_id % 4 AS shard, event_type, count(*) AS c FROM events GROUP BY ALL) GROUP BY event_type")
def shard_facet_merge(spark, sf):
    shards = table(spark, sf, "events").groupBy((F.col("event_id") % 4).alias("shard"), F.col("event_type").alias("label")).agg(F.count("*").alias("c"))
    return shards.groupBy("label").agg(F.sum("c").alias("count"))


@query("WITH m AS (SELECT vec_id AS old, row_number() OVER (ORDER BY label, vec_id) - 1 AS new FROM embeddings) SELECT e.vec_id, m.new AS new_id, e.label FROM embeddings e JOIN m ON e.vec_id = m.old")
def id_remap(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    order = prep.dense_ordinal(e.withColumn("k", F.struct("label", "vec_id")), "k").select("vec_id", F.col("ordinal").alias("new_id"))
    return e.join(order, "vec_id").select("vec_id", "new_id", "label")


@query("SELECT l_partkey AS part, max(l_extendedprice) AS best, count(*) AS children FROM lineitem GROUP BY l_partkey")
def block_join_max(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.max("l_extendedprice").alias("best"), F.count("*").alias("children"))


@query("SELECT o_orderkey AS id, 'missing' AS kind FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem) UNION ALL SELECT l_orderkey, 'extra' FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)")
def id_set_diff(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))  # noqa: E741
    return o.subtract(l).withColumn("kind", F.lit("missing")).unionByName(l.subtract(o).withColumn("kind", F.lit("extra")))


# ---- statistics, over events as the result log: category event_type, latency value
@query("WITH r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events), s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM r WHERE i > 3) SELECT event_type, round(median(value), 6) AS median FROM s WHERE k <= n - floor(n * 0.1) GROUP BY event_type")
def median_trim(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", "value")
    return stats.trimmed_median(e, ["event_type"], ["event_id"], "value").select("event_type", F.round("median", 6).alias("median"))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, p, value FROM r, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE), (0.999::DOUBLE), (1.0::DOUBLE)) AS q(p) WHERE k = floor((n - 1) * p)")
def nearest_rank_pcts(spark, sf):
    return stats.rank_percentiles(table(spark, sf, "events").select("event_type", "value"), ["event_type"], "value", [0.5, 0.9, 0.99, 0.999, 1.0])


@query("SELECT event_type, count(value) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stdev, round(stddev_pop(value), 6) AS stdev_pop, round(stddev_samp(value) / avg(value), 6) AS cv FROM events GROUP BY event_type")
def mean_stdev_cv(spark, sf):
    return stats.spread(table(spark, sf, "events"), ["event_type"], "value")


@query()
def t_test(spark, sf):
    e = table(spark, sf, "events").withColumn("side", F.when(F.col("event_id") % 2 == 0, "base").otherwise("new"))
    return stats.t_test(e, ["event_type"], "side", "value", "base", "new")


@query("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events")
def rolling_n(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return stats.rolling_mean(e, ["user_id"], ["ts", "event_id"], "value", 5).select("event_id", "user_id", F.round("rolling", 6).alias("rolling"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW), 4) AS rolling FROM events")
def rolling_time(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return stats.rolling_time(e, ["user_id"], F.floor(F.unix_timestamp(F.col("ts").cast("timestamp"))), "value", 86400).select("event_id", F.round("rolling", 4).alias("rolling"))


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS events, round(count(*) / 3600.0, 6) AS qps FROM events GROUP BY 1")
def per_second_qps(spark, sf):
    e = table(spark, sf, "events").groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("events"))
    return e.withColumn("qps", F.round(F.col("events") / 3600.0, 6))


@query("WITH b AS (SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bucket FROM events) SELECT event_type, bucket, count(*) AS n FROM b GROUP BY ALL")
def histogram(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.floor(F.col("value") / 10).alias("bucket")).agg(F.count("*").alias("n"))


@query("WITH h AS (SELECT user_id, event_id, round(value, 0) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(value, 0) DESC, event_id) AS rk FROM events), s AS (SELECT *, CASE WHEN lag(score) OVER (PARTITION BY user_id ORDER BY rk) = score THEN 0 ELSE 1 END AS new FROM h), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY rk) AS tie FROM s) SELECT user_id, CAST(tie AS BIGINT) AS tie, any_value(score) AS score, array_to_string(list_sort(list(event_id)), ',') AS docs FROM g GROUP BY user_id, tie")
def tie_collapse(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events").select("user_id", "event_id", F.round("value", 0).alias("score"))
    h = e.withColumn("rk", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "event_id")))
    return stats.tie_groups(h, ["user_id"], "rk", "score", "event_id").select("user_id", "tie", "score", F.array_join("docs", ",").alias("docs"))


@query(f"WITH {TRIPS} SELECT cab_color, count(*) AS rides, round(avg(total_amount), 4) AS mean_total, max(tip_amount) AS most_tip FROM t WHERE (pickup_latitude BETWEEN 40.75 AND 40.9 OR pickup_latitude BETWEEN 40.6 AND 40.65) AND NOT isnan(total_amount) AND abs(total_amount) < 1e9 GROUP BY cab_color")
def sparse_or_range(spark, sf):
    lat = F.col("pickup_latitude")
    own = trips(spark, sf).where((lat.between(40.75, 40.9) | lat.between(40.6, 40.65)) & ~F.isnan("total_amount") & (F.abs("total_amount") < 1e9))
    return own.groupBy("cab_color").agg(F.count("*").alias("rides"), F.round(F.avg("total_amount"), 4).alias("mean_total"), F.max("tip_amount").alias("most_tip"))


@query(f"WITH {TRIPS} SELECT trip_id, pickup_longitude FROM t WHERE pickup_longitude BETWEEN -180 AND 180 AND NOT isnan(pickup_longitude) ORDER BY pickup_longitude, trip_id LIMIT 20")
def sort_double(spark, sf):
    own = trips(spark, sf).where(F.col("pickup_longitude").between(-180, 180) & ~F.isnan("pickup_longitude"))
    return own.orderBy("pickup_longitude", "trip_id").limit(20).select("trip_id", "pickup_longitude")


@query("WITH a AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS m FROM a WHERE i > least(10, greatest(1, n // 10))) SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stdev FROM b WHERE r <= m - floor(m * 0.02) GROUP BY event_type")
def reopen_stats(spark, sf):
    s = stats.settled(table(spark, sf, "events").select("event_type", "event_id", "value"), ["event_type"], "event_id", "value")
    return s.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"))


@query("WITH a AS (SELECT username AS q, list(doc_id ORDER BY doc_id) AS x FROM documents WHERE username IS NOT NULL GROUP BY 1), b AS (SELECT username AS q, list(doc_id ORDER BY doc_id) AS y FROM documents WHERE username IS NOT NULL AND doc_id % 7 <> 0 GROUP BY 1) SELECT q, CASE WHEN y IS NULL THEN 'missing' ELSE 'different' END AS kind FROM a LEFT JOIN b USING (q) WHERE y IS NULL OR x <> y")
def compare_results(spark, sf):
    lists = lambda d: d.groupBy(F.col("username").alias("q")).agg(F.array_sort(F.collect_list("doc_id")).alias("l"))
    d = table(spark, sf, "documents").select("doc_id", "username").where("username is not null")
    return stats.compare_lists(lists(d), lists(d.where("doc_id % 7 != 0")), "q", "l")
