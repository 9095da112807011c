"""Vector ingest and sweeps, sorted maps, id sets, run statistics, header and feed clean-up, task lines of bands."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import facets, prep, sortedmap, timings
from lodestone.operators import vectors as v
from lodestone.queries.registry import SQL, query
from lodestone.queries.text import DICT, docs, words
from lodestone.queries.vectors import DOT, SCORE, _e, _every, _out, top
from lodestone.runtime import scratch
from lodestone.sources import readers
from lodestone.tables import table

ASKED = "q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0)"


def every(sql: str) -> str:
    """The SQL of five asked vectors for the whole query set."""
    return sql.replace("vec_id IN (0, 1, 2, 3, 4)", "vec_id % 100 = 0")


# ---- vectors
@query(every(top("dot", where="e.label % 2 = 0")))
def knn_index_filter(spark, sf):
    """Vectors that pass a filter are written to an index of their own, and only those are searched."""
    path = scratch(spark, "filtered")
    _e(spark, sf).where("label % 2 = 0").select("vec_id", "embedding").write.parquet(path)
    return _out(v.knn(spark.read.parquet(path), _every(spark, sf), 10, "dot"))


@query(every(top("dot", where="e.vec_id % 5 = 0")))
def knn_sparse_field(spark, sf):
    """A vector field that one row in five has."""
    own = _e(spark, sf).withColumn("embedding", F.when(F.col("vec_id") % 5 == 0, F.col("embedding")))
    return _out(v.knn(own, _every(spark, sf), 10, "dot"))


BYTES = "list_transform({}, lambda x: CAST(greatest(least(round(CAST(x AS DOUBLE) * 127), 127), -128) AS DOUBLE))"
BYTE_DOT = f"list_sum(list_transform(range(1, 65), lambda i: {BYTES.format('e.embedding')}[i] * {BYTES.format('q.qv')}[i]))"


@query(f"WITH {ASKED}, s AS (SELECT query_id, vec_id, round((1 + {BYTE_DOT}) / 2, 9) AS score FROM embeddings e, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s) SELECT query_id, vec_id, round(score, 6) AS score, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 10")
def knn_byte(spark, sf):
    """Byte vectors: scaled to 127 and cut."""
    narrow = lambda d: d.withColumn("embedding", v.scale_clip(F.col("embedding"), 127))
    return _out(v.knn(narrow(_e(spark, sf)), narrow(_every(spark, sf)), 10, "dot"))


def _rough(bits: int) -> str:
    step = 2.0 / ((1 << bits) - 1)
    return f"list_transform(embedding, lambda x: CAST(round((least(greatest(CAST(x AS DOUBLE), -1.0), 1.0) + 1.0) / {step!r}) * {step!r} + -1.0 AS FLOAT))"


def reranked(bits: int, over: int, asked: str = ASKED) -> str:
    return (
        f"{asked}, e0 AS (SELECT vec_id, embedding AS exact, {_rough(bits)} AS embedding FROM embeddings), s AS (SELECT query_id, vec_id, exact, qv, round({SCORE['dot']}, 9) AS score FROM e0 e, q), "
        f"c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s), x AS (SELECT query_id, vec_id, round((1 + {DOT.replace('e.embedding', 'exact').replace('q.qv', 'qv')}) / 2, 9) AS score FROM c WHERE k <= {10 * over}), "
        "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM x)"
    )


def recall_sql(bits: int, over: int, asked: str = ASKED) -> str:
    """Recall of quantised search with reranking against the exact lists."""
    return (
        f"(WITH {reranked(bits, over, asked)}, t0 AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round({SCORE['dot']}, 9) DESC, vec_id) AS rk FROM embeddings e, q), t AS (SELECT * FROM t0 WHERE rk <= 10) "
        "SELECT CAST(count(r.vec_id) AS DOUBLE) / count(*) FROM t LEFT JOIN (SELECT * FROM r WHERE rk <= 10) r USING (query_id, vec_id))"
    )


SWEEP = [(2, 1), (2, 5), (4, 1), (4, 2), (7, 1), (8, 1)]


@query(" UNION ALL ".join(f"SELECT {b} AS bits, {o} AS oversample, round({recall_sql(b, o)}, 6) AS recall" for b, o in SWEEP))
def knn_sweep(spark, sf):
    """Recall over a grid of bits and oversampling."""
    truth = v.knn(_e(spark, sf), _every(spark, sf), 10, "dot")
    out = None
    for bits, over in SWEEP:
        r = v.recall(v.rerank(_e(spark, sf), _every(spark, sf), 10, over, bits), truth, "query_id", "vec_id").select(F.lit(bits).alias("bits"), F.lit(over).alias("oversample"), F.round("recall", 6).alias("recall"))
        out = r if out is None else out.unionByName(r)
    return out


_FIVE = ASKED.replace("vec_id % 100 = 0", "vec_id IN (0, 1, 2, 3, 4)")
for _name, _asked in (("", _FIVE), ("_all", ASKED)):
    SQL[f"oversample_rerank{_name}"] = f"WITH {reranked(4, 5, _asked)} SELECT query_id, vec_id, round(score, 6) AS score, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= 10"
    SQL[f"rerank_recall{_name}"] = f"SELECT {recall_sql(4, 5, _asked)} AS recall"


@query()
def knn_variance(spark, sf):
    """Recall of 4-bit search after block rotations by several seeds: seed, recall."""
    truth = v.knn(_e(spark, sf), _every(spark, sf), 10, "dot")
    out = None
    for seed in range(3):
        turned = v.hadamard(_e(spark, sf), "vec_id", "embedding", 64, seed=seed)
        asked = v.hadamard(_every(spark, sf), "query_id", "embedding", 64, seed=seed)
        r = v.recall(v.rerank(turned, asked, 10, 1, 4), truth, "query_id", "vec_id").select(F.lit(seed).alias("seed"), "recall")
        out = r if out is None else out.unionByName(r)
    return out


@query(f"WITH {ASKED}, s AS (SELECT query_id, vec_id, round({SCORE['dot']}, 9) AS score FROM embeddings e, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s) SELECT query_id, array_to_string(list(printf('%.6f', score) ORDER BY rk), ',') AS scores FROM r WHERE rk <= 10 GROUP BY query_id")
def topk_scores(spark, sf):
    """The score arrays of the lists only."""
    best = v.knn(_e(spark, sf), _every(spark, sf), 10, "dot").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("s"))
    return best.select("query_id", F.array_join(F.transform("s", lambda x: F.format_string("%.6f", x["score"])), ",").alias("scores"))


@query("SELECT label AS parent, vec_id AS child, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place, count(*) OVER (PARTITION BY label) AS children FROM embeddings")
def parent_block_ingest(spark, sf):
    """Children written as contiguous blocks by parent, read back with their place in the block."""
    path = scratch(spark, "blocks")
    _e(spark, sf).repartitionByRange("label", "vec_id").sortWithinPartitions("label", "vec_id").write.parquet(path)
    w = Window.partitionBy("label")
    back = spark.read.parquet(path)
    return back.select(F.col("label").alias("parent"), F.col("vec_id").alias("child"), (F.row_number().over(w.orderBy("vec_id")) - 1).cast("long").alias("place"), F.count("*").over(w).alias("children"))


@query("SELECT vec_id, CASE WHEN vec_id % 100 = 0 THEN 'queries' ELSE 'docs' END AS part, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[64] AS DOUBLE), 6) AS last FROM embeddings")
def vector_ingest(spark, sf):
    """Embeddings of a Parquet source to float32 files of documents and queries, read back by record."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = None
    for part, rows in (("docs", e.where("vec_id % 100 != 0")), ("queries", e.where("vec_id % 100 = 0"))):
        path = scratch(spark, f"vectors-{part}")
        readers.write_vector_records(rows, "embedding", "vec_id", path)
        back = readers.vector_records(spark, path, 64)
        own = prep.dense_ordinal(rows.select("vec_id"), "vec_id")
        got = own.join(back, "ordinal").select("vec_id", F.lit(part).alias("part"), F.round(F.col("vector")[0].cast("double"), 6).alias("first"), F.round(F.col("vector")[63].cast("double"), 6).alias("last"))
        out = got if out is None else out.unionByName(got)
    return out


# ---- maps and sets
def _map(spark, sf):
    return sortedmap.SortedMap.build(words(spark, sf), "term", "df", scratch(spark, "map"))


@query(f"WITH {DICT} SELECT term AS key, df AS value FROM dict WHERE starts_with(term, 'se')")
def map_prefix(spark, sf):
    return _map(spark, sf).prefix("se")


@query(f"WITH {DICT} SELECT term AS key, df AS value FROM dict WHERE term >= 'seg' ORDER BY term LIMIT 1")
def map_advance(spark, sf):
    return _map(spark, sf).advance("seg")


@query(f"WITH {DICT} SELECT term AS key, df AS value FROM dict WHERE term >= 'ma' AND term < 'mf'")
def map_enumerate(spark, sf):
    return _map(spark, sf).between("ma", "mf")


@query("SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'")
def idset_iterate(spark, sf):
    return sortedmap.unpack_ids(sortedmap.pack_ids(table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey"), "l_orderkey"))


@query("SELECT min(l_orderkey) AS id FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey >= 1001")
def idset_advance(spark, sf):
    return sortedmap.advance_ids(sortedmap.pack_ids(table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey"), "l_orderkey"), 1001)


# ---- runs
_PS = "(VALUES (0.0::DOUBLE, 1), (0.5::DOUBLE, 1), (0.9::DOUBLE, 10), (0.99::DOUBLE, 100), (0.999::DOUBLE, 1000), (0.9999::DOUBLE, 10000), (0.99999::DOUBLE, 100000), (0.999999::DOUBLE, 1000000), (1.0::DOUBLE, 1)) AS q(p, need)"


@query(f"WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, p, value FROM r, {_PS} WHERE n >= need AND k = floor((n - 1) * p)")
def log_spaced_percentiles(spark, sf):
    return timings.decade_percentiles(table(spark, sf, "events").select("event_type", "value"), ["event_type"], "value")


@query("WITH b AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS bucket, value FROM events), l AS (SELECT bucket, (count(*) // 5) * 5 AS load FROM b GROUP BY bucket), r AS (SELECT load, value, row_number() OVER (PARTITION BY load ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY load) AS n FROM b JOIN l USING (bucket) WHERE value IS NOT NULL) SELECT load, p, value FROM r, (VALUES (0.5::DOUBLE), (0.99::DOUBLE)) AS q(p) WHERE k = floor((n - 1) * p)")
def load_point_percentiles(spark, sf):
    return timings.load_percentiles(table(spark, sf, "events").select("ts", "value"), F.unix_timestamp(F.col("ts").cast("timestamp")), 3600, "value", 5, [0.5, 0.99])


@query("SELECT event_type AS query, user_id % 3 AS sort, count(*) AS runs, min(event_id % 4) AS least, max(event_id % 4) AS most, min(event_id % 4) = max(event_id % 4) AS same FROM events GROUP BY ALL")
def hits_summary(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("query"), (F.col("user_id") % 3).alias("sort"), (F.col("event_id") % 4).alias("hits"))
    return timings.hit_summary(e, ["query", "sort"], "hits")


@query(r"WITH w AS (SELECT len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS s, len(list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '')) AS t FROM documents WHERE text IS NOT NULL) SELECT 'standard' AS analyzer, count(*) AS docs, CAST(sum(s) AS BIGINT) AS tokens, max(s) AS most FROM w UNION ALL SELECT 'whitespace', count(*), CAST(sum(t) AS BIGINT), max(t) FROM w")
def analyzer_summary(spark, sf):
    d = docs(spark, sf).analysed().where("text is not null")
    parts = F.filter(F.split("text", r"[ \t\r\n]+"), lambda x: x != "")
    sizes = F.explode(F.array(*[F.struct(F.lit(n).alias("analyzer"), F.size(c).cast("long").alias("n")) for n, c in (("standard", F.col("__body")), ("whitespace", parts))])).alias("x")
    return d.select(sizes).groupBy("x.analyzer").agg(F.count("*").alias("docs"), F.sum("x.n").alias("tokens"), F.max("x.n").alias("most"))


_STEP = "CASE WHEN event_id % 3 < 2 THEN 1 ELSE -1 END"


@query(f"SELECT event_type, event_id, CAST(sum({_STEP}) OVER w AS BIGINT) AS live, CAST(sum({_STEP} * (user_id + 1)) OVER w AS BIGINT) AS live_bytes FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def segment_timeline(spark, sf):
    """Segments and bytes live after every event; an event in three closes a segment here."""
    e = table(spark, sf, "events").select("event_type", "event_id", "ts", "user_id")
    return timings.timeline(e, ["event_type"], ["ts", "event_id"], F.col("event_id") % 3 < 2, F.col("event_id") % 3 == 2, F.col("user_id") + 1).select("event_type", "event_id", "live", "live_bytes")


@query("SELECT event_type, CAST(sum(CASE WHEN event_id % 3 < 2 THEN user_id + 1 ELSE 0 END) AS BIGINT) AS flushed, CAST(sum(CASE WHEN event_id % 3 = 2 THEN user_id + 1 ELSE 0 END) AS BIGINT) AS merged, round(sum(user_id + 1) / sum(CASE WHEN event_id % 3 < 2 THEN user_id + 1 ELSE 0 END), 6) AS amplification FROM events GROUP BY event_type")
def write_amplification(spark, sf):
    e = table(spark, sf, "events")
    out = timings.write_amplification(e, ["event_type"], F.col("event_id") % 3 < 2, F.col("event_id") % 3 == 2, F.col("user_id") + 1)
    return out.withColumn("amplification", F.round("amplification", 6))


# ---- feeds
@query("SELECT trip_id, vendor_id, passenger_count, CAST(trip_id % 3 AS INTEGER) AS month FROM taxi_trips")
def monthly_union(spark, sf):
    """Monthly files whose headers differ in case, spaces and order, as one table under normal names."""
    t = table(spark, sf, "taxi_trips").select("trip_id", "vendor_id", "passenger_count")
    heads = [["trip_id", "vendor_id", "passenger_count"], [" Passenger_Count", "Trip_ID ", "VENDOR_ID"], ["vendor id", "passenger count", "trip id"]]
    plain = lambda h: readers.normal_name(h)
    paths = []
    for month, names in enumerate(heads):
        paths.append(scratch(spark, f"month-{month}"))
        t.where(F.col("trip_id") % 3 == month).select(*[F.col(plain(h)).alias(h) for h in names]).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(paths[-1])
    back = readers.csv_union(spark, paths)
    return back.select(F.col("trip_id").cast("long").alias("trip_id"), "vendor_id", F.col("passenger_count").cast("int").alias("passenger_count"), (F.col("trip_id").cast("long") % 3).cast("int").alias("month"))


@query("WITH c AS (SELECT event_type AS label, count(*) AS count FROM events GROUP BY 1) SELECT label, count FROM c ORDER BY count DESC, label LIMIT 2")
def facet_merge_protocol(spark, sf):
    """Shards send their first labels, and are asked again for candidates they did not send."""
    shards = table(spark, sf, "events").groupBy((F.col("event_id") % 4).alias("shard"), F.col("event_type").alias("label")).agg(F.count("*").alias("c"))
    return facets.merge_shards(shards, [], 2, 4)


@query(f"WITH {DICT}, m AS (SELECT max(df) AS m FROM dict), b AS (SELECT term, df, CAST(floor(log2(m / df)) AS BIGINT) AS band, row_number() OVER (PARTITION BY CAST(floor(log2(m / df)) AS BIGINT) ORDER BY df DESC, term) AS r FROM dict, m), s AS (SELECT band, r, term FROM b WHERE r <= 3) SELECT band, 'Msm' || band || ': ' || array_to_string(list(term ORDER BY r), ' ') || ' +minShouldMatch=2' AS line FROM s GROUP BY band HAVING count(*) = 3")
def msm_task_lines(spark, sf):
    """A minShouldMatch line of the three most frequent terms of each band of powers of two."""
    d = words(spark, sf).select("term", "df")
    most = float(d.agg(F.max("df")).first()[0] or 1)
    own = d.withColumn("band", F.floor(F.log2(F.lit(most) / F.col("df"))))
    salted = Window.partitionBy("band", F.pmod(F.xxhash64("term"), F.lit(64))).orderBy(F.desc("df"), "term")
    own = own.withColumn("r", F.row_number().over(salted)).where("r <= 3")
    own = own.withColumn("r", F.row_number().over(Window.partitionBy("band").orderBy(F.desc("df"), "term"))).where("r <= 3")
    lines = own.groupBy("band").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("t")).where("n = 3")
    return lines.select("band", F.concat(F.lit("Msm"), F.col("band").cast("string"), F.lit(": "), F.array_join("t", " "), F.lit(" +minShouldMatch=2")).alias("line"))
