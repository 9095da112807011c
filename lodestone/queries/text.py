"""Full-text queries: matching, scoring, positions, dictionary, sorting, grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import collect, tasks
from lodestone.plans import dsl, index, planner
from lodestone.plans import spec as q
from lodestone.queries.registry import query
from lodestone.tables import table

COLUMNS = ["doc_id", "lang", "source", "username", "n_chars", "updated_at", "text"]


def docs(spark: SparkSession, sf: str) -> planner.Corpus:
    """The documents' index; built at the first query of a session that finds none."""
    d = table(spark, sf, "documents").select(*COLUMNS).withColumn("ordinal", F.col("doc_id"))
    return index.open_index("documents", d, "doc_id", {"body": "text"}, ("ordinal",))


def pages(spark: SparkSession, sf: str) -> planner.Corpus:
    """The index of line_docs, once an id."""
    d = table(spark, sf, "line_docs").select("id", "title", "text", "character_count", "ref_count", "username", "random_label", "vector", "received_at").where("id is not null")
    at = F.col("received_at")
    d = d.dropDuplicates(["id"]).withColumns({
        "ordinal": tx.from_base36(F.col("id")), "lastmod": F.unix_millis(at.cast("timestamp")), "month": F.date_format(at, "MMMM"), "dayofyear": F.dayofyear(at),
        "timesecnum": F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at), "year": F.year(at)})
    return index.open_index("pages", d.drop("received_at"), "id", {"title": "title", "body": "text"})


def words(spark: SparkSession, sf: str) -> DataFrame:
    """(term, df, ttf) of the documents' texts."""
    return docs(spark, sf).dictionary("body")


# SQL pieces
D = r"d AS (SELECT doc_id, lang, source, username, n_chars, updated_at, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)"
L = (
    r"l0 AS (SELECT id, any_value(title) AS title, any_value(text) AS text FROM line_docs WHERE id IS NOT NULL GROUP BY id), "
    r"l AS (SELECT id, title, text, regexp_extract_all(lower(title), '[\p{L}\p{N}]+') AS a, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM l0)"
)


def has(t: str, w: str = "w") -> str:
    return f"coalesce(list_contains({w}, '{t}'), false)"


def tf(t: str, w: str = "w") -> str:
    return f"len(list_filter({w}, lambda x: x = '{t}'))"


def pos(t: str, w: str = "w") -> str:
    return f"list_filter(list_transform({w}, lambda x, i: CASE WHEN x = '{t}' THEN i END), lambda p: p IS NOT NULL)"


def stats(terms: list[str], src: str = "d", w: str = "w", as_: str = "st") -> str:
    dfs = ", ".join(f"count(*) FILTER (WHERE {has(t, w)}) AS df_{t}" for t in terms)
    return f"{as_} AS (SELECT count({w}) AS n, avg(len({w})) AS al, {dfs} FROM {src})"


def bm(t: str, w: str = "w", st: str = "st") -> str:
    f = tf(t, w)
    return f"(CASE WHEN {f} > 0 THEN ln(1 + ({st}.n - {st}.df_{t} + 0.5) / ({st}.df_{t} + 0.5)) * {f} / ({f} + 1.2 * (0.25 + 0.75 * len({w}) / {st}.al)) ELSE 0 END)"


def top_sql(where: str, score: str, terms: list[str], n: int = 10) -> str:
    return f"WITH {D}, {stats(terms)} SELECT doc_id, round({score}, 6) AS score FROM d, st WHERE {where} ORDER BY round({score}, 6) DESC, doc_id LIMIT {n}"


def count_sql(where: str) -> str:
    return f"WITH {D} SELECT count(*) AS hit_count FROM d WHERE {where}"


def ids_sql(where: str) -> str:
    return f"WITH {D} SELECT doc_id FROM d WHERE {where}"


def ids(spark, sf, node) -> DataFrame:
    return planner.ids(docs(spark, sf), node)


T = q.Term


@query(top_sql(has("segment"), bm("segment"), ["segment"]))
def term_top10(spark, sf):
    return planner.search(docs(spark, sf), T("segment"), 10)


@query(top_sql(f"{has('segment')} AND {has('query')}", f"{bm('segment')} + {bm('query')}", ["segment", "query"]))
def and_top10(spark, sf):
    return planner.search(docs(spark, sf), dsl.classic("+segment +query"), 10)


@query(top_sql(f"{has('segment')} OR {has('latency')}", f"{bm('segment')} + {bm('latency')}", ["segment", "latency"]))
def or_top10(spark, sf):
    return planner.search(docs(spark, sf), dsl.classic("segment latency"), 10)


@query(top_sql(f"{has('segment')} AND ({has('latency')} OR {has('facet')})", f"{bm('segment')} + {bm('latency')} + {bm('facet')}", ["segment", "latency", "facet"]))
def nested_and_or(spark, sf):
    return planner.search(docs(spark, sf), dsl.classic("+segment +(latency facet)"), 10)


@query(top_sql(f"{has('segment')} AND NOT {has('latency')}", bm("segment"), ["segment"]))
def not_top10(spark, sf):
    return planner.search(docs(spark, sf), dsl.classic("+segment -latency"), 10)


_MSM = " + ".join(f"CASE WHEN {has(t)} THEN 1 ELSE 0 END" for t in ("segment", "latency", "facet"))


@query(top_sql(f"({_MSM}) >= 2", " + ".join(bm(t) for t in ("segment", "latency", "facet")), ["segment", "latency", "facet"]))
def msm2(spark, sf):
    return planner.search(docs(spark, sf), dsl.parse("Msm: segment latency facet +minShouldMatch=2").query, 10)


@query(f"WITH {D} SELECT doc_id, CAST(({_MSM}) AS DOUBLE) AS score FROM d WHERE ({_MSM}) >= 2 ORDER BY score DESC, doc_id LIMIT 10")
def const_msm2(spark, sf):
    return planner.search(docs(spark, sf), dsl.parse("Msm: segment latency facet +minShouldMatch=2 +constantScore").query, 10)


@query("SELECT count(*) AS hit_count FROM documents")
def match_all_count(spark, sf):
    return planner.count(docs(spark, sf), q.MatchAll())


@query(f"WITH {D} SELECT doc_id, lang FROM d WHERE {has('zzzqqq')} AND {has('segment')} ORDER BY lang, doc_id LIMIT 10")
def missing_term(spark, sf):
    return collect.sort_by(planner.hits(docs(spark, sf), dsl.classic("+zzzqqq +segment")), [F.col("lang")], "doc_id", 10).select("doc_id", "lang")


@query(count_sql(has("segment")))
def count_term(spark, sf):
    return planner.count(docs(spark, sf), dsl.parse("Count: count(segment)").query)


@query(count_sql(f"{has('segment')} AND {has('query')}"))
def count_and(spark, sf):
    return planner.count(docs(spark, sf), dsl.parse("Count: count(+segment +query)").query)


@query(count_sql(f"{has('segment')} OR {has('query')}"))
def count_or(spark, sf):
    return planner.count(docs(spark, sf), dsl.parse("Count: count(segment query)").query)


PHRASE = f"len(list_filter({pos('the')}, lambda p: w[p + 1] = 'segment' AND w[p + 2] = 'merge')) > 0"


@query(count_sql(PHRASE))
def count_phrase(spark, sf):
    return planner.count(docs(spark, sf), dsl.parse('Count: count("the segment merge")').query)


@query(count_sql(f"({has('segment')} OR {has('query')}) AND doc_id % 20 = (31 * (doc_id // 20)) % 20"))
def count_filtered_or(spark, sf):
    return planner.count(docs(spark, sf), dsl.parse("Count: count(segment query) +filter=5%").query)


@query(ids_sql(PHRASE))
def phrase(spark, sf):
    return ids(spark, sf, dsl.classic('"the segment merge"'))


@query(ids_sql(f"len(list_filter({pos('the')}, lambda p: w[p + 1] IN ('segment', 'latency') AND w[p + 2] IN ('merge', 'chart'))) > 0"))
def multi_phrase(spark, sf):
    return ids(spark, sf, dsl.parse("MultiPhrase: multiPhrase//(body:the segment|latency merge|chart)").query)


def gap(a: str, b: str) -> str:
    return f"list_min(list_transform({pos(a)}, lambda p: list_min(list_filter({pos(b)}, lambda x: x > p)) - p + 1))"


@query(ids_sql(f"{gap('segment', 'index')} - 2 <= 10"))
def near10(spark, sf):
    return ids(spark, sf, dsl.parse("Near: near//segment index").query)


@query(ids_sql(f"{gap('segment', 'index')} <= 10"))
def ordered_width10(spark, sf):
    return ids(spark, sf, dsl.parse("Ordered: ordered//segment index").query)


@query(ids_sql(f"list_position(w, 'index') BETWEEN 1 AND 5"))
def span_first5(spark, sf):
    return ids(spark, sf, q.First("index", 5))


@query(ids_sql(f"{has('merge')} OR {has('filter')} OR {has('chart')}"))
def plain_disjunction(spark, sf):
    return ids(spark, sf, dsl.parse("Dis: intervalDis//(body:merge|filter|chart)").query)


def two_within(a: str, b: str, slop: int) -> str:
    return f"len(list_filter({pos(a)}, lambda p: len(list_filter({pos(b)}, lambda x: abs(x - 1 - p) <= {slop})) > 0)) > 0"


@query(ids_sql(two_within("segment", "rows", 4)))
def sloppy_phrase(spark, sf):
    return ids(spark, sf, dsl.classic('"segment rows"~4'))


@query(ids_sql(" OR ".join(f"{gap(a, b)} - 2 <= 8" for a in ("segment", "facet") for b in ("rows", "order"))))
def span_dis(spark, sf):
    return ids(spark, sf, dsl.parse("SpanDis: spanDis//(body:segment|facet rows|order)~8").query)


@query(ids_sql(" OR ".join(f"len(list_filter({pos(a)}, lambda p: w[p + 1] = '{b}')) > 0" for a in ("segment", "latency") for b in ("merge", "chart"))))
def interval_dis(spark, sf):
    return ids(spark, sf, dsl.parse("IntervalDis: intervalMinDis//(body:segment|latency merge|chart)~0").query)


@query(count_sql("len(list_filter(w, lambda x: starts_with(x, 'seg'))) > 0"))
def prefix3(spark, sf):
    return planner.count(docs(spark, sf), dsl.classic("seg*"))


@query(count_sql("len(list_filter(w, lambda x: regexp_full_match(x, 's.*t'))) > 0"))
def wildcard(spark, sf):
    return planner.count(docs(spark, sf), dsl.classic("s*t"))


@query(count_sql("len(list_filter(w, lambda x: levenshtein(x, 'segmant') <= 1)) > 0"))
def fuzzy1(spark, sf):
    return planner.count(docs(spark, sf), dsl.classic("segmant~1"))


@query(count_sql("len(list_filter(w, lambda x: levenshtein(x, 'latincy') <= 2)) > 0"))
def fuzzy2(spark, sf):
    return planner.count(docs(spark, sf), dsl.classic("latincy~2"))


DICT = f"{D}, dict AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(w) AS term FROM d) GROUP BY term)"


@query(f"WITH {DICT} SELECT term, df FROM dict WHERE damerau_levenshtein(term, 'sgement') <= 1")
def fuzzy_swap(spark, sf):
    d = words(spark, sf).select("term", "df")
    return d.where(collect.damerau(F.col("term"), "sgement", 1))


@query(f"WITH {DICT} SELECT term, CAST(levenshtein(term, 'indax') AS INTEGER) AS distance, df FROM dict WHERE levenshtein(term, 'indax') BETWEEN 1 AND 2 AND df > coalesce((SELECT max(df) FROM dict WHERE term = 'indax'), 0) ORDER BY distance, df DESC, term LIMIT 10")
def respell(spark, sf):
    return collect.respell(words(spark, sf).select("term", "df"), "indax")


@query(f"WITH {DICT} SELECT term, df FROM dict WHERE starts_with(term, 'se') ORDER BY df DESC, term LIMIT 10")
def suggest(spark, sf):
    return collect.suggest(words(spark, sf).select("term", "df"), "se")


@query(f"WITH {DICT}, m AS (SELECT max(df) AS m FROM dict) SELECT term, df, CASE WHEN df >= m // 10 THEN 'High' WHEN df >= m // 100 THEN 'Med' ELSE 'Low' END AS band FROM dict, m")
def term_bands(spark, sf):
    d = words(spark, sf).select("term", "df")
    most = d.agg(F.max("df")).first()[0] or 0
    band = F.when(F.col("df") >= most // 10, "High").when(F.col("df") >= most // 100, "Med").otherwise("Low")
    return d.withColumn("band", band)


@query(rf"WITH {D}, s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS shingle FROM d WHERE len(w) >= 2), c AS (SELECT shingle, count(*) AS df FROM s GROUP BY shingle), m AS (SELECT max(df) AS m FROM c) SELECT shingle, df, CASE WHEN df >= m // 10 THEN 'High' WHEN df >= m // 100 THEN 'Med' ELSE 'Low' END AS band FROM c, m WHERE df >= greatest(2, m // 1000)")
def shingle_bands(spark, sf):
    d = docs(spark, sf).analysed().select(F.col("__body").alias("w"))
    c = d.select(F.explode(F.array_distinct(tx.shingles(F.col("w")))).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("df"))
    most = c.agg(F.max("df")).first()[0] or 0
    c = c.where(F.col("df") >= max(2, most // 1000))
    return c.withColumn("band", F.when(F.col("df") >= most // 10, "High").when(F.col("df") >= most // 100, "Med").otherwise("Low"))


@query(f"WITH {DICT}, m AS (SELECT max(df) AS m FROM dict) SELECT CAST(floor(log2(m / df)) AS BIGINT) AS band, count(*) AS terms, min(df) AS least_df, max(df) AS most_df FROM dict, m GROUP BY 1")
def msm_bands(spark, sf):
    d = words(spark, sf).select("term", "df")
    most = d.agg(F.max("df")).first()[0] or 0
    return d.groupBy(F.floor(F.log2(F.lit(float(most)) / F.col("df"))).alias("band")).agg(F.count("*").alias("terms"), F.min("df").alias("least_df"), F.max("df").alias("most_df"))


@query(f"WITH {D}, p AS (SELECT doc_id, unnest(w) AS term FROM d) SELECT term, count(*) AS ttf, count(DISTINCT doc_id) AS df FROM p GROUP BY term")
def vocabulary(spark, sf):
    return words(spark, sf).select("term", "ttf", "df")


@query(f"WITH {D}, p AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d) SELECT term, doc_id AS doc, count(*) AS tf, min(pos) AS first_pos, max(pos) AS last_pos FROM p GROUP BY term, doc_id")
def postings(spark, sf):
    p = docs(spark, sf).postings.where("field = 'body'")
    return p.select("term", "doc", F.col("tf").cast("long").alias("tf"), F.array_min("positions").cast("long").alias("first_pos"), F.array_max("positions").cast("long").alias("last_pos"))


# ---- scoring over fields
_TWO = f"{L}, {stats(['archive'], 'l', 'w', 'sb')}, {stats(['archive'], 'l', 'a', 'sa')}"


@query(f"WITH {_TWO} SELECT id, round(greatest(CASE WHEN {has('archive', 'a')} THEN {bm('archive', 'a', 'sa')} ELSE 0 END, CASE WHEN {has('archive')} THEN {bm('archive', 'w', 'sb')} ELSE 0 END), 6) AS score FROM l, sa, sb WHERE {has('archive')} OR {has('archive', 'a')} ORDER BY score DESC, id LIMIT 10")
def dismax_fields(spark, sf):
    return planner.search(pages(spark, sf), dsl.parse("Dismax: archive +dismaxFields=title,body").query, 10)


_B2 = [bm("archive"), bm("treasure")]


@query(f"WITH {L}, {stats(['archive', 'treasure'], 'l')} SELECT id, round(greatest({_B2[0]}, {_B2[1]}) + 0.1 * (({_B2[0]} + {_B2[1]}) - greatest({_B2[0]}, {_B2[1]})), 6) AS score FROM l, st WHERE {has('archive')} OR {has('treasure')} ORDER BY score DESC, id LIMIT 10")
def dismax_tie01(spark, sf):
    return planner.search(pages(spark, sf), dsl.parse("Dismax: disjunctionMax//archive treasure").query, 10)


@query(f"WITH {L}, {stats(['archive', 'treasure'], 'l')} SELECT id, round(greatest({_B2[0]}, {_B2[1]}) + 0.1 * (({_B2[0]} + {_B2[1]}) - greatest({_B2[0]}, {_B2[1]})), 6) AS score FROM l JOIN (SELECT DISTINCT id, character_count FROM line_docs) USING (id), st WHERE ({has('archive')} OR {has('treasure')}) AND character_count BETWEEN 500 AND 900 ORDER BY score DESC, id LIMIT 10")
def filtered_dismax(spark, sf):
    return planner.search(pages(spark, sf), dsl.parse("Dismax: disjunctionMax//archive treasure +dvRangeFilter=character_count,500,900").query, 10)


def _f2(t: str) -> str:
    f = f"(3.0 * coalesce({tf(t, 'a')}, 0) + coalesce({tf(t)}, 0))"
    df = f"greatest(sa.df_{t}, sb.df_{t})"
    return f"(CASE WHEN {f} > 0 THEN ln(1 + (greatest(sa.n, sb.n) - {df} + 0.5) / ({df} + 0.5)) * {f} / ({f} + 1.2 * (0.25 + 0.75 * (3.0 * coalesce(len(a), 0) + coalesce(len(w), 0)) / (3.0 * sa.al + sb.al))) ELSE 0 END)"


@query(f"WITH {L}, {stats(['archive', 'treasure'], 'l', 'w', 'sb')}, {stats(['archive', 'treasure'], 'l', 'a', 'sa')} SELECT id, round({_f2('archive')} + {_f2('treasure')}, 6) AS score FROM l, sa, sb WHERE {has('archive')} OR {has('treasure')} OR {has('archive', 'a')} OR {has('treasure', 'a')} ORDER BY score DESC, id LIMIT 10")
def bm25f_two_fields(spark, sf):
    return planner.search(pages(spark, sf), dsl.parse("Combined: archive treasure +combinedFields=title^3.0,body").query, 10)


# ---- numeric, sort, pages
@query("SELECT doc_id FROM documents WHERE n_chars BETWEEN 200 AND 400")
def int_range(spark, sf):
    return ids(spark, sf, dsl.parse("NRQ: nrq//n_chars 200 400").query)


@query("SELECT count(*) AS hit_count FROM documents WHERE n_chars BETWEEN 200 AND 400")
def dv_range(spark, sf):
    return planner.count(docs(spark, sf), dsl.parse("Range: count(dvrange//n_chars 200 400)").query)


@query("SELECT doc_id FROM documents WHERE n_chars IN (100, 200, 300, 400, 500)")
def int_set(spark, sf):
    return ids(spark, sf, dsl.parse("IntSet: intSet//n_chars 100 200 300 400 500").query)


@query("SELECT doc_id FROM documents WHERE lang IS NOT NULL")
def field_exists(spark, sf):
    return ids(spark, sf, q.Exists("lang"))


@query("SELECT doc_id FROM documents WHERE doc_id % 10 = (31 * (doc_id // 10)) % 10")
def filter_pct(spark, sf):
    return ids(spark, sf, q.Sampled(10))


@query(f"WITH {D} SELECT doc_id, source FROM d WHERE {has('segment')} ORDER BY source NULLS FIRST, doc_id LIMIT 20")
def sort_str(spark, sf):
    return collect.sort_by(planner.hits(docs(spark, sf), T("segment")), [F.col("source")], "doc_id", 20).select("doc_id", "source")


@query(f"WITH {D} SELECT doc_id, n_chars FROM d WHERE {has('segment')} ORDER BY n_chars DESC, doc_id LIMIT 20")
def sort_num(spark, sf):
    return collect.sort_by(planner.hits(docs(spark, sf), T("segment")), [F.desc("n_chars")], "doc_id", 20).select("doc_id", "n_chars")


@query(f"WITH {D} SELECT doc_id, updated_at FROM d WHERE {has('segment')} AND updated_at IS NOT NULL ORDER BY updated_at, doc_id LIMIT 20")
def sort_ts(spark, sf):
    return collect.sort_by(planner.hits(docs(spark, sf), T("segment")).where("updated_at is not null"), [F.col("updated_at")], "doc_id", 20).select("doc_id", "updated_at")


@query(f"WITH {D} SELECT doc_id, n_chars FROM d WHERE {has('segment')} AND (n_chars > 800 OR (n_chars = 800 AND doc_id > 0)) ORDER BY n_chars, doc_id LIMIT 20")
def search_after(spark, sf):
    return collect.search_after(planner.hits(docs(spark, sf), T("segment")), "n_chars", "doc_id", 800, 0, 20).select("doc_id", "n_chars")


@query(f"WITH {D}, {stats(['segment'])}, h AS (SELECT doc_id, source, round({bm('segment')}, 6) AS score FROM d, st WHERE {has('segment')} AND source IS NOT NULL), g AS (SELECT source, max(score) AS group_best FROM h GROUP BY source ORDER BY group_best DESC, source LIMIT 10), r AS (SELECT source, doc_id, score, group_best, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS group_rank FROM h JOIN g USING (source)) SELECT source, doc_id, score, group_best, CAST(group_rank AS INTEGER) AS group_rank FROM r WHERE group_rank <= 10")
def group_top10x10(spark, sf):
    h = planner.scored(docs(spark, sf), T("segment")).select("doc_id", "source", "score")
    return collect.group_top(h, "source", [F.desc("score"), F.col("doc_id")], F.col("score"), 10, 10).select("source", "doc_id", "score", "group_best", "group_rank")


@query(f"WITH {D} SELECT count(DISTINCT doc_id % 100) AS groups FROM d WHERE {has('segment')}")
def group_count(spark, sf):
    return planner.ids(docs(spark, sf), T("segment")).agg(F.count_distinct(F.col("doc_id") % 100).alias("groups"))


@query(f"WITH {D}, h AS (SELECT doc_id, doc_id // 10 AS block, n_chars FROM d WHERE {has('segment')} AND n_chars IS NOT NULL), g AS (SELECT block, max(n_chars) AS group_best FROM h GROUP BY block ORDER BY group_best DESC, block LIMIT 10), r AS (SELECT block, doc_id, n_chars, row_number() OVER (PARTITION BY block ORDER BY n_chars DESC, doc_id) AS rn FROM h JOIN g USING (block)) SELECT block, doc_id, n_chars, CAST(rn AS INTEGER) AS group_rank FROM r WHERE rn <= 10")
def block_group(spark, sf):
    h = planner.hits(docs(spark, sf), T("segment")).where("n_chars is not null").select("doc_id", F.floor(F.col("doc_id") / 10).alias("block"), "n_chars")
    return collect.group_top(h, "block", [F.desc("n_chars"), F.col("doc_id")], F.col("n_chars"), 10, 10).select("block", "doc_id", "n_chars", "group_rank")


@query()
def highlight(spark, sf):
    return collect.highlight(planner.hits(docs(spark, sf), dsl.classic("segment merge")), "doc_id", "text", ["segment", "merge"])


@query(f"WITH {L} SELECT id, a AS words, len(w) AS n_words FROM l WHERE title IS NOT NULL")
def analyse_standard(spark, sf):
    return planner.hits(pages(spark, sf), q.Exists("title")).select("id", F.col("__title").alias("words"), F.when(F.col("__body").isNotNull(), F.size("__body").cast("long")).alias("n_words"))


_STOP = ", ".join(f"'{w}'" for w in tx.STOP)


@query(rf"WITH {D} SELECT doc_id, len(list_filter(w, lambda x: x NOT IN ({_STOP}))) AS n_words FROM d WHERE text IS NOT NULL")
def analyse_stop(spark, sf):
    w = tx.without_stop_words(F.col("__body"))
    return docs(spark, sf).analysed().where("__body is not null").select("doc_id", F.size(w).cast("long").alias("n_words"))


@query(rf"WITH {L} SELECT id, array_to_string(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]), '|') AS shingles FROM l WHERE len(a) >= 2")
def analyse_shingles(spark, sf):
    h = pages(spark, sf).analysed().where(F.size("__title") >= 2)
    return h.select("id", F.array_join(tx.shingles(F.col("__title")), "|").alias("shingles"))


@query(rf"WITH {L} SELECT id, array_to_string(flatten(list_transform(a, lambda x: list_transform(range(1, least(3, length(x)) + 1), lambda n: substr(x, 1, n)))), '|') AS grams FROM l WHERE title IS NOT NULL")
def analyse_edge_ngrams(spark, sf):
    h = pages(spark, sf).analysed().where("title is not null")
    return h.select("id", F.array_join(tx.edge_ngrams(F.col("__title")), "|").alias("grams"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '')) AS n_tokens FROM documents WHERE text IS NOT NULL")
def analyse_whitespace(spark, sf):
    parts = F.filter(F.split("text", r"[ \t\r\n]+"), lambda x: x != "")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(parts).cast("long").alias("n_tokens"))


@query(f"WITH {D} SELECT doc_id, CASE WHEN len(w) > 0 THEN w[1 + CAST(list_reduce(list_transform(string_split(substr(md5(CAST(doc_id AS VARCHAR)), 1, 8), ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT)), lambda x, y: x * 16 + y) % len(w) AS BIGINT)] END AS label FROM d")
def random_label(spark, sf):
    w = F.col("__body")
    number = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long")
    pick = F.element_at(w, (F.pmod(number, F.size(w)) + 1).cast("int"))
    return docs(spark, sf).analysed().select("doc_id", F.when(F.size(w) > 0, pick).alias("label"))


_CL = f"sqrt({tf('segment')}) * power(1 + ln((st.n + 1) / (st.df_segment + 1)), 2) / sqrt(len(w))"


@query(top_sql(has("segment"), _CL, ["segment"]))
def classic_top10(spark, sf):
    return planner.search(docs(spark, sf), T("segment"), 10, "classic")


@query(f"WITH {D} SELECT doc_id, CAST({' + '.join(f'CAST({has(t)} AS INTEGER)' for t in ('segment', 'latency'))} AS DOUBLE) AS score FROM d WHERE {has('segment')} OR {has('latency')} ORDER BY score DESC, doc_id LIMIT 10")
def boolean_top10(spark, sf):
    return planner.search(docs(spark, sf), dsl.classic("segment latency"), 10, "boolean")


@query(f"WITH {D}, h AS (SELECT doc_id FROM d WHERE {has('segment')} ORDER BY doc_id LIMIT 10) SELECT doc_id, source, username FROM documents JOIN h USING (doc_id)")
def stored_fields(spark, sf):
    """The stored fields of hits: an equi-join of ten ids with the documents."""
    h = ids(spark, sf, T("segment")).orderBy("doc_id").limit(10)
    return table(spark, sf, "documents").select("doc_id", "source", "username").join(h, "doc_id", "left_semi")


@query()
def generated_tasks(spark, sf):
    return tasks.generate(words(spark, sf).select("term", "df"))
