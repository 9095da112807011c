"""Vector queries over embeddings (vec_id, embedding, label)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import prep
from lodestone.operators import vectors as v
from lodestone.queries.registry import SQL, query
from lodestone.tables import table


def _e(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def _q(spark, sf):
    """The five query vectors that the SQL of these queries states; the whole set is asked by their namesakes in _all."""
    return table(spark, sf, "embeddings").where("vec_id in (0, 1, 2, 3, 4)").select(F.col("vec_id").alias("query_id"), "embedding")


def _every(spark, sf):
    """The whole query set: every row whose id is divisible by 100."""
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


Q = "q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id IN (0, 1, 2, 3, 4))"
DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(q.qv[i] AS DOUBLE)))"
SQ = "list_sum(list_transform(range(1, 65), lambda i: (CAST(e.embedding[i] AS DOUBLE) - CAST(q.qv[i] AS DOUBLE)) * (CAST(e.embedding[i] AS DOUBLE) - CAST(q.qv[i] AS DOUBLE))))"
NRM = lambda x: f"sqrt(list_sum(list_transform({x}, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))"
SCORE = {
    "dot": f"(1 + {DOT}) / 2",
    "cosine": f"(1 + {DOT} / ({NRM('e.embedding')} * {NRM('q.qv')})) / 2",
    "euclidean": f"1 / (1 + {SQ})",
    "mip": f"CASE WHEN {DOT} >= 0 THEN 1 + {DOT} ELSE 1 / (1 - {DOT}) END",
}


def top(metric: str, k: int = 10, where: str = "true") -> str:
    return (
        f"WITH {Q}, s AS (SELECT query_id, vec_id, label, round({SCORE[metric]}, 9) AS score FROM embeddings e, q WHERE {where}), "
        f"r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s) "
    ) + f"SELECT query_id, vec_id, round(score, 6) AS score, CAST(rk AS INTEGER) AS rank FROM r WHERE rk <= {k}"


def _out(df):
    return df.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(top("dot"))
def knn_dot(spark, sf, asked=_q):
    return _out(v.knn(_e(spark, sf), asked(spark, sf), 10, "dot"))


@query(top("cosine"))
def knn_cosine(spark, sf, asked=_q):
    return _out(v.knn(_e(spark, sf), asked(spark, sf), 10, "cosine"))


@query(top("euclidean"))
def knn_euclid(spark, sf, asked=_q):
    return _out(v.knn(_e(spark, sf), asked(spark, sf), 10, "euclidean"))


@query(top("mip"))
def knn_mip(spark, sf, asked=_q):
    return _out(v.knn(_e(spark, sf), asked(spark, sf), 10, "mip"))


@query(top("dot", where="e.label % 2 = 0"))
def knn_prefilter(spark, sf, asked=_q):
    return _out(v.knn(_e(spark, sf).where("label % 2 = 0"), asked(spark, sf), 10, "dot"))


@query(top("dot") + " AND label % 2 = 0")
def knn_postfilter(spark, sf, asked=_q):
    best = v.knn(_e(spark, sf), asked(spark, sf), 10, "dot")
    return _out(best.join(_e(spark, sf).where("label % 2 = 0").select("vec_id"), "vec_id", "left_semi"))


@query(f"WITH {Q} SELECT query_id, vec_id, round(round({SCORE['dot']}, 9), 6) AS score FROM embeddings e, q WHERE round({SCORE['dot']}, 9) >= 0.65")
def knn_radius(spark, sf, asked=_q):
    return v.knn(_e(spark, sf), asked(spark, sf), 0, "dot", least=0.65).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query(
    f"WITH {Q}, s AS (SELECT query_id, vec_id, label, round({SCORE['dot']}, 9) AS score FROM embeddings e, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s), "
    "p AS (SELECT query_id, label, max(score) AS score FROM r WHERE rk <= 50 GROUP BY query_id, label), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rk FROM p) "
    "SELECT query_id, label, round(score, 6) AS score, CAST(rk AS INTEGER) AS rank FROM t WHERE rk <= 5"
)
def knn_parent_max(spark, sf, asked=_q):
    best = v.knn(_e(spark, sf), asked(spark, sf), 50, "dot").join(_e(spark, sf).select("vec_id", "label"), "vec_id")
    return v.best_per_parent(best, "query_id", "label", 5).select("query_id", "label", F.round("score", 6).alias("score"), "rank")


@query(
    f"WITH {Q}, s AS (SELECT query_id, vec_id, label, round({SCORE['dot']}, 9) AS score FROM embeddings e, q), c AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS k FROM s), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM c WHERE k = 1) SELECT query_id, vec_id, label, round(score, 6) AS score FROM r WHERE rk <= 5"
)
def knn_diversified(spark, sf, asked=_q):
    """The best child of each parent: exact, so every parent's best is found before the cut."""
    from pyspark.sql import Window

    best = v.knn(_e(spark, sf), asked(spark, sf), 0, "dot", parent="label")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("r", rank).where("r <= 5").select("query_id", "vec_id", "label", F.round("score", 6).alias("score"))


@query("SELECT CAST(1.0 AS DOUBLE) AS recall")
def recall_at_k(spark, sf):
    """Recall of the exact search against itself: one by definition."""
    truth = v.knn(_e(spark, sf), _q(spark, sf), 10, "dot")
    return v.recall(truth, truth, "query_id", "vec_id")


@query()
def oversample_rerank(spark, sf, asked=_q):
    return v.rerank(_e(spark, sf), asked(spark, sf), 10, 5, 4).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query()
def rerank_recall(spark, sf, asked=_q):
    truth = v.knn(_e(spark, sf), asked(spark, sf), 10, "dot")
    return v.recall(v.rerank(_e(spark, sf), asked(spark, sf), 10, 5, 4), truth, "query_id", "vec_id")


@query("SELECT dim, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS stdev, count(*) FILTER (x = 0) AS zeros FROM (SELECT unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY dim")
def vec_dim_stats(spark, sf):
    s = v.dimension_stats(_e(spark, sf), "embedding")
    return s.select("dim", "n", F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"), "zeros")


@query(
    "WITH x AS (SELECT unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x, vec_id % 5 = 0 AS a FROM embeddings), s AS (SELECT dim, avg(x) FILTER (a) AS ma, avg(x) FILTER (NOT a) AS mb, stddev_samp(x) FILTER (a) AS sa, stddev_samp(x) FILTER (NOT a) AS sb, "
    "count(x) FILTER (a) AS na, count(x) FILTER (NOT a) AS nb FROM x GROUP BY dim) SELECT dim, round((ma - mb) / sqrt(sa * sa / na + sb * sb / nb), 5) AS z, round(sb / sa, 6) AS spread_ratio FROM s"
)
def vec_drift(spark, sf):
    e = _e(spark, sf)
    d = v.drift(e.where("vec_id % 5 = 0"), e.where("vec_id % 5 != 0"), "embedding")
    return d.select("dim", F.round("z", 5).alias("z"), F.round("spread_ratio", 6).alias("spread_ratio"))


@query("WITH a AS (SELECT embedding AS x, count(*) AS n FROM embeddings WHERE vec_id % 2 = 0 GROUP BY 1), b AS (SELECT embedding AS x, count(*) AS n FROM embeddings WHERE vec_id % 2 = 1 GROUP BY 1) SELECT CAST(coalesce((SELECT sum(a.n) FROM a JOIN b USING (x)), 0) AS BIGINT) AS shared, CAST(coalesce((SELECT sum(n - 1) FROM a WHERE n > 1), 0) AS BIGINT) AS repeats_a, CAST(coalesce((SELECT sum(n - 1) FROM b WHERE n > 1), 0) AS BIGINT) AS repeats_b")
def dup_overlap(spark, sf):
    e = _e(spark, sf)
    return v.overlap(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "embedding")


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(CAST(greatest(least(round(CAST(x AS DOUBLE) * 127), 127), -128) AS INTEGER) AS VARCHAR)), ',') AS bytes FROM embeddings")
def vec_to_bytes(spark, sf):
    return _e(spark, sf).select("vec_id", F.array_join(F.transform(v.scale_clip(F.col("embedding"), 127), lambda x: x.cast("string")), ",").alias("bytes"))


@query("SELECT label, round(sqrt(list_sum(list_transform(range(64), lambda i: s[i + 1] * s[i + 1]))), 6) AS length FROM (SELECT label, list(x ORDER BY dim) AS s FROM (SELECT label, dim, sum(x) AS x FROM (SELECT label, unnest(range(64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, dim) GROUP BY label)")
def vec_sum_length(spark, sf):
    flat = _e(spark, sf).select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.sum(F.col("x").cast("double")).alias("x"))
    return flat.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("length"))


@query()
def hadamard(spark, sf):
    return v.hadamard(_e(spark, sf), "vec_id", "embedding", 64)


@query()
def intrinsic_dimension(spark, sf):
    return v.intrinsic_dimension(_e(spark, sf), _every(spark, sf), "embedding", "vec_id").unionByName(v.principal_dimension(_e(spark, sf), "embedding", 64))


@query(top("dot", where=f"substr(md5(CAST(e.vec_id AS VARCHAR) || ':3'), 1, 8) < '{int(20 / 100 * (1 << 32)):08x}'"))
def random_filter_knn(spark, sf, asked=_q):
    kept = _e(spark, sf).where(prep.chosen(F.col("vec_id"), 20, 3))
    return _out(v.knn(kept, asked(spark, sf), 10, "dot"))


@query("WITH RECURSIVE n AS (SELECT n_nationkey AS id FROM nation), e AS (SELECT n_nationkey AS src, n_nationkey + 5 AS dst FROM nation WHERE n_nationkey + 5 < 25), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT id, id AS c FROM n UNION SELECT b.dst, r.c FROM r JOIN b ON b.src = r.id) SELECT id, min(c) AS component FROM r GROUP BY id")
def graph_components(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"))
    e = n.select(F.col("id").alias("src"), (F.col("id") + 5).alias("dst")).where("dst < 25")
    return v.components(n, e)


@query("SELECT fanout, count(*) AS nodes FROM (SELECT l_orderkey, count(*) AS fanout FROM lineitem GROUP BY l_orderkey) GROUP BY fanout")
def graph_fanout(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("fanout")).groupBy("fanout").agg(F.count("*").alias("nodes"))


@query(f"WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT round({SCORE['dot']}, 9) AS score FROM embeddings e, q WHERE query_id <> vec_id) SELECT round(floor((score * 2 - 1) / 0.05) * 0.05, 2) AS bucket, count(*) AS pairs FROM s GROUP BY 1")
def sampled_distances(spark, sf):
    return v.sampled_distances(_e(spark, sf), _every(spark, sf), "embedding", "vec_id")


@query("WITH RECURSIVE n AS (SELECT r_regionkey AS id FROM region), e AS (SELECT id AS src, (id + 1) % 3 AS dst FROM n WHERE id < 3 UNION SELECT id, id + 1 FROM n WHERE id BETWEEN 2 AND 3), r AS (SELECT id AS a, id AS b FROM n UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT r.a AS id, min(r.b) AS component FROM r JOIN r s ON r.a = s.b AND r.b = s.a GROUP BY r.a")
def graph_strong_components(spark, sf):
    n = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"))
    i = F.col("id")
    e = n.where("id < 3").select(i.alias("src"), ((i + 1) % 3).alias("dst")).unionByName(n.where("id between 2 and 3").select(i.alias("src"), (i + 1).alias("dst")))
    return v.strong_components(n, e)


def _whole(f):
    def whole(spark, sf):
        return f(spark, sf, _every)

    whole.__name__, whole.__doc__ = f"{f.__name__}_all", f"{f.__name__} asked for every id divisible by 100, against all rows."
    sql = SQL.get(f.__name__)
    return query(sql and sql.replace("vec_id IN (0, 1, 2, 3, 4)", "vec_id % 100 = 0"))(whole)


for _f in (knn_dot, knn_cosine, knn_euclid, knn_mip, knn_prefilter, knn_postfilter, knn_radius, knn_parent_max, knn_diversified, oversample_rerank, rerank_recall, random_filter_knn):
    _whole(_f)
