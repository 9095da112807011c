"""Round trips through the other formats: lines are written as the format has them and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.queries.registry import query
from lodestone.runtime import scratch
from lodestone.sources import readers
from lodestone.tables import table


def _lines(df, line, *, by=None) -> str:
    """Write one line a row; with ``by`` a file a value."""
    path = scratch(df.sparkSession, "format")
    if by is None:
        df.select(line.alias("value")).write.text(path)
    else:
        df.select(line.alias("value"), by).repartition(by).write.partitionBy(by).text(path)
    return path


def _text(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


@query("SELECT 'w' || vec_id AS word, len(embedding) AS dim, round(CAST(embedding[3] AS DOUBLE), 5) AS third FROM embeddings")
def source_token_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    path = _lines(e, F.concat_ws(" ", _text("w", F.col("vec_id").cast("string")), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")))
    back = readers.token_vectors(spark, path)
    return back.select("word", F.size("v").cast("long").alias("dim"), F.round(F.col("v")[2].cast("double"), 5).alias("third"))


_OK = "pickup_latitude BETWEEN -90 AND 90 AND pickup_longitude BETWEEN -180 AND 180 AND NOT isnan(pickup_latitude) AND NOT isnan(pickup_longitude)"


def _places(spark, sf):
    t = table(spark, sf, "taxi_trips").select("trip_id", "pickup_latitude", "pickup_longitude").where("trip_id is not null").dropDuplicates(["trip_id"])
    return t.where(_OK)


@query(f"SELECT DISTINCT trip_id AS id, pickup_latitude AS lat, pickup_longitude AS lon FROM taxi_trips WHERE {_OK}")
def source_points(spark, sf):
    path = scratch(spark, "format")
    _places(spark, sf).write.csv(path)
    return readers.points(spark, path)


@query(f"SELECT DISTINCT trip_id AS id, pickup_latitude AS lat, pickup_longitude AS lon FROM taxi_trips WHERE {_OK}")
def source_map_nodes(spark, sf):
    c = lambda n: F.col(n).cast("string")
    return readers.map_nodes(spark, _lines(_places(spark, sf), _text('  <node id="', c("trip_id"), '" version="1" lat="', c("pickup_latitude"), '" lon="', c("pickup_longitude"), '"/>')))


@query("SELECT r_name AS region, n_name AS nation, c_name AS customer FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 7 <> 0")
def source_hierarchy(spark, sf):
    """Compressed lines of levels; those with a blank level are dropped."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = scratch(spark, "format")
    c.select("r_name", "n_name", F.when(F.col("c_custkey") % 7 == 0, F.lit(" ")).otherwise(F.col("c_name"))).write.option("compression", "gzip").csv(path)
    return readers.hierarchy(spark, path, ["region", "nation", "customer"])


@query("SELECT CAST(c_custkey AS INTEGER) AS id, c_name AS name, CAST(c_custkey % 90 AS DOUBLE) AS latitude, c_custkey * 1000 AS population, 1577836800000 AS modified FROM customer")
def source_place_names(spark, sf):
    cells = [F.lit("")] * 19
    k = F.col("c_custkey")
    for i, x in ((0, k), (1, F.col("c_name")), (4, k % 90), (5, -(k % 180)), (14, k * 1000), (18, F.lit("2020-01-01"))):
        cells[i] = x.cast("string")
    back = readers.place_names(spark, _lines(table(spark, sf, "customer"), F.concat_ws("\t", *cells)))
    return back.select("id", "name", "latitude", "population", "modified")


@query("SELECT id, any_value(username) AS username FROM line_docs WHERE id IS NOT NULL AND username IS NOT NULL GROUP BY id")
def source_wiki_pages(spark, sf):
    """Pages of a dump; the redirects among them are dropped."""
    d = table(spark, sf, "line_docs").where("id is not null and username is not null").dropDuplicates(["id"]).select("id", "username")
    redirect = d.select(F.concat(F.lit("r"), "id").alias("id"), "username", F.lit("#REDIRECT [[x]]").alias("t"))
    page = d.withColumn("t", F.lit("'''Bold''' [[a|b]]\n== Head ==\n[[Category:C]]")).unionByName(redirect)
    path = scratch(spark, "format")
    revision = F.struct(F.lit("2020-01-01T00:00:00Z").alias("timestamp"), F.struct("username").alias("contributor"), F.col("t").alias("text"))
    page.select(F.col("id").alias("title"), revision.alias("revision")).write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)
    return readers.wiki_pages(spark, path).where("section_count = 1 and categories = 'C'").select(F.col("title").alias("id"), "username")


@query("SELECT place_id, len(rings) AS rings, len(rings[1]) AS corners, round(rings[1][1].latitude, 6) AS latitude FROM zones")
def source_geojson(spark, sf):
    corner = lambda p: F.concat(F.lit("["), p["longitude"].cast("string"), F.lit(","), p["latitude"].cast("string"), F.lit("]"))
    ring = lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, corner), ","), F.lit("]"))
    z = table(spark, sf, "zones").select("place_id", F.array_join(F.transform("rings", ring), ",").alias("r"))
    back = readers.geojson(spark, _lines(z, _text('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[', F.col("r"), "]}}"), by="place_id"))
    return back.select(F.regexp_extract("path", "place_id=([^/]+)/", 1).alias("place_id"), F.size("rings").cast("long").alias("rings"), F.size(F.col("rings")[0]).cast("long").alias("corners"), F.round(F.col("rings")[0][0]["latitude"], 6).alias("latitude"))


@query("SELECT printf('%08x', n_nationkey) AS disc_id, r_name AS artist, n_name AS album, 2 AS tracks FROM nation JOIN region ON n_regionkey = r_regionkey")
def source_disc_metadata(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = _text("# xmcd\nDISCID=", F.lower(F.lpad(F.hex("n_nationkey"), 8, "0")), "\nDTITLE=", F.col("r_name"), " / ", F.col("n_name"), "\nTTITLE0=one\nTTITLE1=two")
    back = readers.disc_metadata(spark, _lines(n, text, by="n_nationkey") + "/*")
    return back.select("disc_id", "artist", "album", F.size("tracks").alias("tracks"))


@query("SELECT event_id + 0.5 AS ts, CASE WHEN event_id % 5 = 0 THEN 'del' ELSE 'add' END AS op, CAST(user_id AS INTEGER) AS docid, CASE WHEN event_id % 5 <> 0 THEN event_id * 10 END AS size_bytes FROM events")
def source_index_events(spark, sf):
    e = F.col("event_id")
    gone = e % 5 == 0
    line = F.concat_ws(" ", (e + 0.5).cast("string"), F.when(gone, "del").otherwise("add"), F.col("user_id").cast("string"), F.when(~gone, (e * 10).cast("string")))
    return readers.index_events(spark, _lines(table(spark, sf, "events"), line))


@query("SELECT event_type AS category, 'body:w' || user_id AS query, event_id AS hit_count, event_id % 2 = 0 AS is_lower_bound, CAST(event_id % 100 AS DOUBLE) + 0.25 AS latency_ms, CAST(event_id % 8 AS INTEGER) AS thread FROM events")
def source_result_log(spark, sf):
    e = F.col("event_id")
    c = lambda x: x.cast("string")
    line = _text("TASK: cat=", F.col("event_type"), " q=body:w", c(F.col("user_id")), " s=null hits=", c(e), F.when(e % 2 == 0, "+").otherwise(""), " facets=[]\t", c((e % 100) + 0.25), " msec @ ", c(e), " msec thread ", c(e % 8))
    return readers.result_log(spark, _lines(table(spark, sf, "events"), line)).select("category", "query", "hit_count", "is_lower_bound", "latency_ms", "thread")


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'flush' ELSE 'merge start' END AS event, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS docs FROM events GROUP BY 1")
def source_segment_log(spark, sf):
    e = F.col("event_id")
    what = F.when(e % 2 == 0, "flush postings as segment _").otherwise("now merge _")
    line = _text("IW 0 [2020-01-02T03:04:05.678901Z; thread-1]: ", what, F.lower(F.conv(e.cast("string"), 10, 36)), " numDocs=", e.cast("string"), " 1.5 MB")
    return readers.segment_log(spark, _lines(table(spark, sf, "events"), line)).groupBy("event").agg(F.count("*").alias("events"), F.sum("docs").alias("docs"))


@query("SELECT 'T' || doc_id AS title, doc_id AS body FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0")
def combined_pages(spark, sf):
    """Titles with bodies by title; service pages and disambiguations are dropped."""
    d, n = table(spark, sf, "documents").select("doc_id"), F.col("doc_id")
    own = F.concat(F.lit("T"), n.cast("string"))
    titles = d.select(F.when(n % 10 == 0, F.concat(F.lit("Category:"), own)).when(n % 5 == 0, F.concat(own, F.lit(" (disambiguation)"))).otherwise(own).alias("title"))
    bodies = d.where(n % 3 == 0).select(F.when(n % 10 == 0, F.concat(F.lit("Category:"), own)).when(n % 5 == 0, F.concat(own, F.lit(" (disambiguation)"))).otherwise(own).alias("title"), n.alias("body"))
    return readers.combine_pages(titles, bodies)


@query("SELECT doc_id, 'é < ' || doc_id || ' & “q” – ü' AS plain FROM documents")
def html_entities(spark, sf):
    """Named, decimal and hexadecimal entities."""
    return table(spark, sf, "documents").select("doc_id", tx.plain_text(_text("<p>&eacute; &lt; ", F.col("doc_id").cast("string"), " &amp;&nbsp;&ldquo;q&#8221; &#x2013; &uuml;</p>")).alias("plain"))


@query("SELECT doc_id, 'wi|fi|' || doc_id || '|html' AS parts FROM documents")
def analyse_word_parts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(tx.word_parts(_text("WiFi", F.col("doc_id").cast("string"), " HTML")), "|").alias("parts"))
