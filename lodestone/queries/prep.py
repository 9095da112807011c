"""Data preparation queries."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import prep
from lodestone.queries.registry import query
from lodestone.runtime import scratch
from lodestone.sources import writers
from lodestone.tables import table


@query("WITH u AS (SELECT DISTINCT username FROM documents WHERE username IS NOT NULL ORDER BY username LIMIT 20) SELECT doc_id, CASE WHEN u.username IS NULL THEN 'docs' ELSE 'queries' END AS part FROM documents d LEFT JOIN u ON d.username = u.username")
def group_partition(spark, sf):
    return prep.first_groups(table(spark, sf, "documents").select("doc_id", "username"), "username", 20).select("doc_id", "part")


@query("SELECT doc_id, username FROM documents")
def group_shuffle(spark, sf):
    return prep.shuffle_groups(table(spark, sf, "documents").select("doc_id", "username"), "username", ["doc_id"])


@query("SELECT doc_id, lang FROM documents")
def row_shuffle(spark, sf):
    return prep.shuffle_rows(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")


@query()
def xor_integrity(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "username", "text")
    return prep.group_digest(d, "username", [F.col("doc_id"), F.col("text")])


@query("SELECT username, 'x' AS kind FROM documents WHERE false")
def integrity_diff(spark, sf):
    """A shuffle loses nothing: no group differs from what it was."""
    d = table(spark, sf, "documents").select("doc_id", "username", "text").where("username is not null")
    content = [F.col("doc_id"), F.col("text")]
    return prep.digest_diff(prep.group_digest(d, "username", content), prep.group_digest(prep.shuffle_rows(d, "doc_id"), "username", content), "username")


_FIELDS = ["vendor_id", "payment_type", "trip_type", "rate_code_id", "store_and_fwd_flag", "surcharge", "ehail_fee", "improvement_surcharge", "passenger_count"]


@query("SELECT field, filled, round(100.0 * filled / (SELECT count(*) FROM taxi_trips), 4) AS percent FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS filled FROM taxi_trips" for f in _FIELDS) + ")")
def sparsity(spark, sf):
    return prep.sparsity(table(spark, sf, "taxi_trips").select(*_FIELDS), _FIELDS)


@query("WITH RECURSIVE r AS (SELECT doc_id, doc_id AS n, '' AS s FROM documents UNION ALL SELECT doc_id, n // 36, substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(n % 36 AS INTEGER) + 1, 1) || s FROM r WHERE length(s) < 6) SELECT doc_id, s AS id, doc_id AS back FROM r WHERE length(s) = 6")
def base36_ids(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").withColumn("id", tx.base36(F.col("doc_id")))
    return d.withColumn("back", tx.from_base36(F.col("id")))


@query("SELECT run_key, string_split(suite_id, '-')[1] AS prefix, CAST(string_split(suite_id, '-')[2] AS BIGINT) AS suite_no FROM knn_result_raw")
def id_split(spark, sf):
    parts = F.split("suite_id", "-")
    return table(spark, sf, "knn_result_raw").select("run_key", parts[0].alias("prefix"), parts[1].cast("long").alias("suite_no"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace('<p class=\"x\">' || source || '</p><br/>' || coalesce(lang, ''), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM documents")
def html_clean(spark, sf):
    html = F.concat(F.lit('<p class="x">'), F.col("source"), F.lit("</p><br/>"), F.coalesce("lang", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", tx.plain_text(html).alias("plain"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_latest(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return prep.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("WITH u AS (SELECT l_orderkey AS o_orderkey, max(l_extendedprice) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT o.o_orderkey, coalesce(u.p, o.o_totalprice) AS o_totalprice FROM orders o LEFT JOIN u USING (o_orderkey)")
def update_column(spark, sf):
    u = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("o_totalprice"))
    return prep.update_column(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), u, "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_by_id(spark, sf):
    gone = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return prep.delete_ids(table(spark, sf, "orders").select("o_orderkey"), gone, "o_orderkey")


@query("WITH n AS (SELECT max(doc_id) + 1 AS n FROM documents) SELECT segment, count(*) AS docs FROM (SELECT CASE WHEN doc_id < n * 100 // 111 THEN 0 WHEN doc_id < n * 110 // 111 THEN 1 ELSE 2 END AS segment FROM documents, n) GROUP BY segment")
def rearranged_segments(spark, sf):
    return prep.sized_segments(table(spark, sf, "documents").select("doc_id"), "doc_id", [100, 10, 1]).groupBy("segment").agg(F.count("*").alias("docs"))


@query("SELECT username, count(*) AS docs, list_sort(list(doc_id))[-1] AS group_end FROM documents WHERE username IS NOT NULL GROUP BY username")
def document_blocks(spark, sf):
    """Blocks of documents with a key in common; the last of a block carries the mark of its end."""
    d = table(spark, sf, "documents").select("doc_id", "username").where("username is not null")
    return d.groupBy("username").agg(F.count("*").alias("docs"), F.max("doc_id").alias("group_end"))


@query("SELECT count(*) AS docs, count(DISTINCT doc_id) AS distinct_ids, max(doc_id) + 1 AS limit_ FROM documents")
def unique_id_check(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("docs"), F.count_distinct("doc_id").alias("distinct_ids"), (F.max("doc_id") + 1).alias("limit_"))


@query("SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber FROM lineitem WHERE l_quantity = 50 EXCEPT ALL SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber FROM lineitem WHERE l_discount = 0.05")
def binary_diff(spark, sf):
    t = table(spark, sf, "lineitem")
    cols = ["l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber"]
    return t.where("l_quantity = 50").select(*cols).exceptAll(t.where("l_discount = 0.05").select(*cols))


@query("SELECT count(*) AS shared FROM (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def partition_intersection(spark, sf):
    t = table(spark, sf, "lineitem")
    return t.where("l_returnflag = 'R'").select("l_orderkey").intersect(t.where("l_returnflag = 'A'").select("l_orderkey")).agg(F.count("*").alias("shared"))


@query("SELECT suite_id, file_id, count(*) AS records, count(*) OVER (PARTITION BY suite_id) AS files FROM knn_result_raw GROUP BY suite_id, file_id")
def count_per_group(spark, sf):
    g = table(spark, sf, "knn_result_raw").groupBy("suite_id", "file_id").agg(F.count("*").alias("records"))
    return g.withColumn("files", F.count("*").over(Window.partitionBy("suite_id")))


@query("SELECT id, strftime(t, '%B') AS month, CAST(dayofyear(t) AS INTEGER) AS day_of_year, CAST(hour(t) * 3600 + minute(t) * 60 + second(t) AS INTEGER) AS second_of_day FROM (SELECT id, min(received_at) AS t FROM line_docs WHERE id IS NOT NULL GROUP BY id)")
def date_parts(spark, sf):
    # the first delivery of an id counts
    d = table(spark, sf, "line_docs").select("id", "received_at").where("id is not null").groupBy("id").agg(F.min("received_at").alias("t"))
    return d.select("id", F.date_format("t", "MMMM").alias("month"), F.dayofyear("t").alias("day_of_year"), (F.hour("t") * 3600 + F.minute("t") * 60 + F.second("t")).alias("second_of_day"))


@query("SELECT doc_id, doc_id % 100 AS group100, doc_id % 10000 AS group10k, doc_id % 100000 AS group100k, doc_id % 1000000 AS group1m FROM documents")
def group_fields(spark, sf):
    n = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", (n % 100).alias("group100"), (n % 10_000).alias("group10k"), (n % 100_000).alias("group100k"), (n % 1_000_000).alias("group1m"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT doc_id, r.round FROM documents, range(3) AS r(round)")
def repeated_source(spark, sf):
    return prep.repeat(table(spark, sf, "documents").select("doc_id"), 3)


@query(f"SELECT doc_id FROM documents WHERE NOT substr(md5(CAST(doc_id AS VARCHAR) || ':1'), 1, 8) < '{int(5 / 100 * (1 << 32)):08x}'")
def delete_random_5pct(spark, sf):
    return prep.delete_share(table(spark, sf, "documents").select("doc_id"), "doc_id", 5)


@query("SELECT event_id FROM events WHERE user_id - 50 BETWEEN -20 AND 10")
def encoded_range(spark, sf):
    """A range over numbers encoded as sortable text gives what the range over the numbers gives."""
    code = lambda n: prep.sortable_hex(F.lit(n))
    return table(spark, sf, "events").where(prep.sortable_hex(F.col("user_id") - 50).between(code(-20), code(10))).select("event_id")


@query()
def disk_usage(spark, sf):
    return writers.disk_usage(table(spark, sf, "documents"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def index_sort(spark, sf):
    """Written in order of the date, so that a range of dates reads few files."""
    path = scratch(spark, "sorted")
    writers.write_sorted(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), path, "o_orderdate")
    return spark.read.parquet(path).where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
