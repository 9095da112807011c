"""Planner, task lines, collectors and facets on hand-made rows."""

import pytest
from lodestone.functions import text as tx
from lodestone.operators import collect, facets, geo, language, prep, segments, stats, vectors
from lodestone.plans import dsl, planner
from lodestone.plans import spec as q
from lodestone.streaming import ingest
from pyspark.sql import functions as F

DOCS = [
    (0, "A title", "The quick brown fox jumps over the lazy dog", "en", 10),
    (1, "Fox", "the fox the fox", "en", 20),
    (2, None, "Un renard été", "fr", None),
    (3, "Empty", "", None, 40),
    (4, "Null", None, "en", 50),
    (5, "Dog", "dog lazy the over brown quick", "de", 10),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return planner.Corpus(spark.createDataFrame(DOCS, "id int, title string, body string, lang string, n int").withColumn("ordinal", F.col("id")), "id", {"body": "body", "title": "title"})


def _ids(corpus, line):
    return sorted(r["id"] for r in planner.hits(corpus, dsl.parse(f"Test: {line}").query).collect())


@pytest.mark.parametrize(
    "line,want",
    [
        ("fox", [0, 1]), ("*:*", [0, 1, 2, 3, 4, 5]), ("+fox +dog", [0]), ("fox dog", [0, 1, 5]), ("+dog -fox", [5]), ("+the +(fox dog)", [0, 1, 5]),
        ('"quick brown"', [0]), ('"brown quick"', [5]), ('"brown fox"~0', [0]), ('"quick fox"~1', [0]), ('"fox quick"~2', []), ('"fox quick"~3', [0]),
        ("near//quick fox", [0]), ("ordered//quick dog", [0]), ("ordered//dog quick", [5]), ("qui*", [0, 5]), ("f*x", [0, 1]), ("fix~1", [0, 1]), ("été", [2]),
        ("nrq//n 10 20", [0, 1, 5]), ("intSet//n 40 50", [3, 4]), ("multiPhrase//(body:quick|the brown|fox)", [0, 1]), ("spanDis//(body:fox|dog lazy|the)~5", [0, 1, 5]),
        ("intervalMinDis//(body:fox|renard)", [0, 1, 2]), ("fox dog lazy +minShouldMatch=2", [0, 5]), ("fox dog +filter=50%", [0, 1, 5]), ("title:dog", [5]), ("the +dvRangeFilter=n,10,10", [0, 5]),
    ],
)
def test_lines_match(corpus, line, want):
    want = [i for i in want if "+filter" not in line or i in {k * 2 + (31 * k) % 2 for k in range(3)}]
    assert _ids(corpus, line) == want


def test_parsed_requests():
    with pytest.warns(UserWarning):
        r = dsl.parse("Cat: hilite//titlesort//a b # 12 hits")
    assert r.highlight and r.sort == "title" and r.category == "Cat"
    assert dsl.parse("C: count(a b) +filter=5%").count
    assert dsl.parse("C: count(nrq//timesecnum) 6754 51441").query == q.Range("timesecnum", 6754, 51441)
    assert dsl.parse("C: a b +combinedFields=title^3.0,body").query == q.Combined(("a", "b"), (("title", 3.0), ("body", 1.0)))
    assert dsl.parse("C: a +drillDown:lang=en,de +drillDown:x=1").drill_down == (("lang", ("en", "de")), ("x", ("1",)))
    assert dsl.parse("C: lastmodndvsort//a +searchAfter=12").after == 12.0
    assert dsl.parse("C: disjunctionMax//a b").query == q.DisMax((q.Term("a"), q.Term("b")), 0.1)
    for bad in ("no category", "C: datetimesort//a", "C: a +minShouldMatch=2"):
        with pytest.raises(ValueError):
            dsl.parse(bad)


def test_scores_rank_and_tie(corpus):
    top = planner.search(corpus, q.Term("fox"), 10).collect()
    assert [r["id"] for r in top] == [1, 0] and top[0]["score"] > top[1]["score"] > 0
    assert planner.search(corpus, q.Bool(must=(q.Term("fox"),), filter=(q.Range("n", 20, None),)), 10).first()["score"] == top[0]["score"]
    assert planner.search(corpus, q.Term("nothing"), 10).count() == 0
    assert planner.search(planner.Corpus(corpus.docs.limit(0), "id", {"body": "body"}), q.Term("fox"), 10).count() == 0


def test_pages_concatenate_to_the_whole_sort(corpus):
    rows = corpus.docs.where("n is not null")
    whole = [(r["n"], r["id"]) for r in rows.orderBy("n", "id").collect()]
    got, value, key = [], -1, -1
    while page := [(r["n"], r["id"]) for r in collect.search_after(rows, "n", "id", value, key, 2).collect()]:
        got += page
        value, key = page[-1]
    assert got == whole


def test_collectors(spark, corpus):
    words = collect.document_frequencies(corpus.docs, "body")
    assert [r["term"] for r in collect.respell(words, "teh", 2).collect()][0] == "the"
    assert collect.osa("ab", "ba") == 1 and collect.osa("abc", "") == 3 and collect.osa("kitten", "sitting") == 3
    out = collect.highlight(corpus.docs, "id", "body", ["fox"], 20, 1).collect()
    assert {r["id"] for r in out} == {0, 1} and all("<b>fox</b>" in r["fragment"] for r in out)
    g = collect.group_top(corpus.docs, "lang", [F.desc("n"), F.col("id")], F.col("n"), 2, 1).select("lang", "id", "group_rank").collect()
    assert {(r["lang"], r["id"], r["group_rank"]) for r in g} == {("en", 4, 1), ("de", 5, 1)}


def test_facets(corpus):
    d = corpus.docs
    assert [(r["label"], r["count"]) for r in facets.flat(d, F.col("lang")).collect()] == [("en", 3), ("de", 1), ("fr", 1)]
    assert [r["count"] for r in facets.ranges(d, "n", [(10, 20), (0, 100), (60, 70)]).collect()] == [2, 5, 0]
    side = {(r["dim"], r["label"]): r["count"] for r in facets.drill_sideways(d, {"lang": ["en"]}, ["lang", "n"]).collect()}
    assert side["lang", "de"] == 1 and ("n", "10") in side and side["n", "10"] == 1
    assert d.select(facets.character_bucket(F.lit(1877)).alias("b")).first()["b"] == ["0 - 1000000", "0 - 100000", "0 - 10000", "1000 - 2000"]


def test_text_functions(spark):
    row = spark.range(1).select(
        tx.base36(F.lit(46655)).alias("a"), tx.from_base36(F.lit("000zzz")).alias("b"), tx.edge_ngrams(F.array(F.lit("ab"))).alias("c"), tx.word_parts(F.lit("WiFi4You HTML")).alias("d"),
        tx.plain_text(F.lit("<p>a &amp; b</p><script>x</script><!-- c -->")).alias("e"), tx.wiki_text(F.lit("{{a{{b}}}}'''Bold''' [[x|y]] [[z]] [http://q w]<ref>r</ref>")).alias("f"))
    r = row.first()
    assert r["a"] == "000zzz" and r["b"] == 46655 and r["c"] == ["a", "ab"] and r["d"] == ["wi", "fi", "4", "you", "html"] and r["e"] == "a & b" and r["f"] == "Bold y z w"


def test_statistics(spark):
    runs = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([100, 100, 100, 1, 2, 3, 4, 5, 6, 7, 8, 9, 50])], "k string, i int, v double")
    assert stats.trimmed_median(runs, ["k"], ["i"], "v").first()["median"] == 5.0
    p = {r["p"]: r["value"] for r in stats.rank_percentiles(runs, ["k"], "v", [0.0, 0.5, 1.0]).collect()}
    assert p == {0.0: 1.0, 0.5: 7.0, 1.0: 100.0}
    two = spark.createDataFrame([("a", s, float(x)) for s, o in (("x", 0), ("y", 50)) for x in range(o, o + 10)], "k string, s string, v double")
    t = stats.t_test(two, ["k"], "s", "v", "x", "y").first()
    assert t["significant"] and t["p"] < 1e-6


def test_preparation(spark):
    d = spark.createDataFrame([(1, "g", 1), (2, "g", 2), (1, "g", 3), (3, "h", 1), (None, "h", 9)], "id int, g string, seq int")
    assert {(r["id"], r["seq"]) for r in prep.latest(d, ["id"], ["seq"]).collect()} == {(1, 3), (2, 2), (3, 1), (None, 9)}
    a = prep.group_digest(d, "g", [F.col("id"), F.col("seq")])
    assert prep.digest_diff(a, prep.group_digest(prep.shuffle_rows(d, "seq"), "g", [F.col("id"), F.col("seq")]), "g").count() == 0
    assert {r["kind"] for r in prep.digest_diff(a, prep.group_digest(d.where("seq != 2"), "g", [F.col("id"), F.col("seq")]), "g").collect()} == {"different"}
    assert [r["ordinal"] for r in prep.dense_ordinal(spark.range(50).toDF("k"), "k").orderBy("k").collect()] == list(range(50))
    whole = [r["g"] for r in prep.shuffle_groups(d, "g", ["seq"]).collect()]
    assert len([1 for x, y in zip(whole, whole[1:]) if x != y]) == 1


def test_whole_merge(spark, tmp_path):
    from lodestone.queries.registry import QUERIES

    rows = [(i, "gyx"[i % 3], f"p{i}", i % 2, (i * 7919) % 500) for i in range(1500)]
    spark.createDataFrame(rows, "trip_id long, cab_color string, pickup_datetime string, trip_type int, received_at int").repartition(5).write.parquet(f"{tmp_path}/taxi_trips.parquet")
    got = [(r["received_at"], r["trip_id"], r["trip_type"]) for r in QUERIES["merge_two_streams_all"](spark, str(tmp_path)).collect()]
    assert got == sorted((r[4], r[0], r[3] if r[1] == "g" else None) for r in rows if r[1] != "x") and len(got) == 1000


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [1.0, 0.0]), (5, [1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    one = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>")
    for metric, best in (("dot", [0, 2, 4]), ("cosine", [0, 4, 2]), ("euclidean", [0, 4, 2]), ("mip", [0, 2, 4]), ("angular", [0, 2, 4])):
        got = [r["vec_id"] for r in vectors.knn(d, one, 3, metric).orderBy("rank").collect()]
        assert got == best, metric
        exact = d.where("size(embedding) = 2").crossJoin(one.select(F.col("embedding").alias("e"))).select("vec_id", F.round(vectors.similarity(F.col("embedding"), F.col("e"), metric), 9).alias("s"))
        s = {r["vec_id"]: r["s"] for r in exact.collect()}
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-8 for r in vectors.knn(d, one, 3, metric).collect())
    wide = spark.createDataFrame([(i, [float((i * j) % 7) for j in range(12)]) for i in range(5)], "vec_id long, embedding array<float>")
    back = vectors.hadamard(vectors.hadamard(wide, "vec_id", "embedding", 12), "vec_id", "embedding", 12, inverse=True)
    want = {r["vec_id"]: r["embedding"] for r in wide.collect()}
    assert all(abs(x - y) < 1e-9 for r in back.collect() for x, y in zip(r["embedding"], want[r["vec_id"]]))
    n = spark.createDataFrame([(i,) for i in range(8)], "id long")
    e = spark.createDataFrame([(0, 1), (1, 2), (5, 6), (3, 3)], "src long, dst long")
    assert {r["id"]: r["component"] for r in vectors.components(n, e).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}


def test_every_hundredth_vector_is_asked(spark, tmp_path, monkeypatch):
    import numpy as np
    from lodestone.queries.registry import QUERIES

    monkeypatch.setattr(vectors, "MAX_QUERIES", 2)
    monkeypatch.setattr(vectors, "MAX_SCORES", 60)
    x = np.random.default_rng(1).integers(-3, 4, (450, 64)).astype(np.float32) / 16
    x[7] = x[300]
    ids, label = np.arange(50, 500), np.arange(450) % 7
    rows = [(int(i), v.tolist(), int(g)) for i, v, g in zip(ids, x, label)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    s = np.round((1 + x.astype(float) @ x.astype(float).T) / 2, 9)
    want, apart = set(), set()
    for q in (100, 200, 300, 400):
        best = sorted(range(450), key=lambda i: (-s[q - 50, i], ids[i]))
        want |= {(q, int(ids[i]), r + 1) for r, i in enumerate(best[:10])}
        firsts = [i for n, i in enumerate(best) if label[i] not in label[best[:n]]]
        apart |= {(q, int(ids[i])) for i in firsts[:5]}
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in QUERIES["knn_dot_all"](spark, str(tmp_path)).collect()} == want
    assert {(r["query_id"], r["vec_id"]) for r in QUERIES["knn_diversified_all"](spark, str(tmp_path)).collect()} == apart
    radius = {(r["query_id"], r["vec_id"]) for r in QUERIES["knn_radius_all"](spark, str(tmp_path)).collect()}
    assert radius == {(q, int(ids[i])) for q in (100, 200, 300, 400) for i in range(450) if s[q - 50, i] >= 0.65}


def test_geo(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 1.0), (2, 0.0, -179.9), (3, 89.9, 10.0), (4, None, 1.0)], "id long, lat double, lon double")
    assert [r["id"] for r in geo.nearest(p, "id", "lat", "lon", (0.0, 179.9), 1).collect()] == [2]
    assert {r["id"] for r in geo.distance(p, "lat", "lon", (0.0, 0.5), 60_000).collect()} == {0, 1}
    assert {r["id"] for r in geo.distance(p, "lat", "lon", (90.0, 0.0), 60_000).collect()} == {3}
    assert {r["id"] for r in geo.box(p, "lat", "lon", -1, 1, 179, -179).collect()} == {2}
    square = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)]
    inner, cross, far = [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0)], [(3.0, 3.0), (3.0, 6.0), (6.0, 6.0)], [(9.0, 9.0), (9.0, 8.0), (8.0, 8.0)]
    assert [geo.relation(x, square) for x in (inner, cross, far)] == ["WITHIN", "INTERSECTS", "DISJOINT"] and geo.relation(square, inner) == "CONTAINS"


def test_segments_and_languages(spark):
    ev = spark.createDataFrame([("s", i, "refresh" if i % 5 == 4 else "update", i % 7, 100) for i in range(40)], "stream string, ts int, op string, docid int, size_bytes long")
    rows = segments.simulate(ev, "stream", ["ts"]).collect()
    assert len(rows) == 8 and rows[-1]["docs"] - rows[-1]["deleted"] == 7
    t = spark.createDataFrame([("the dog and the cat was in the house",), ("der Hund und die Katze",), ("собака",), ("本当か",), (None,), ("123",)], "t string")
    assert [r[0] for r in t.select(language.detect(F.col("t"))).collect()] == ["en", "de", "ru", "ja", None, None]
    v = spark.createDataFrame([(1, "en"), (1, "de"), (2, "fr"), (2, "fr"), (2, "en"), (3, None)], "k int, l string")
    assert {(r["k"], r["l"]) for r in language.majority(v, "k", "l", "en").collect()} == {(1, "en"), (2, "fr")}


def test_upserts_and_late_rows(spark, tmp_path):
    for rows in ([(1, 1, "a"), (2, 1, "b")], [(1, 3, "c"), (1, 2, "x")], [(3, 1, "d")]):
        spark.createDataFrame(rows, "k int, seq int, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    into = ingest.Versions(spark)
    assert into.read() is None
    ingest.upsert(ingest.replay(spark, f"{tmp_path}/in"), ["k"], ["seq"], into)
    assert {(r["k"], r["v"]) for r in into.read().collect()} == {(1, "c"), (2, "b"), (3, "d")}
    assert len(into.numbers()) <= into.keep
