"""Running a task line's request against a corpus.

What comes out depends on the task: ``hit_count`` for counts; (id, score) for plain searches;
(id, sort_value) for sorted ones, behind ``after`` if given; (group, id, score, group_rank) for
groups; (dim, label, count) for facets; (id, fragment_no, fragment) for highlights; (term,
distance, df) for respelling; (id, score) for vectors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import collect, facets, vectors
from lodestone.plans import dsl, planner
from lodestone.plans import spec as q


@dataclass
class Setting:
    """How the names of the task format stand for columns of a corpus.

    ``columns``: plain columns by the format's name; ``fields``: analysed fields; ``groups`` and
    ``dims``: expressions of group and facet names; ``vector``: the vector column and its length;
    ``word_vectors``: (word, v), for vector tasks that state words.
    """

    corpus: planner.Corpus
    columns: dict[str, str] = field(default_factory=dict)
    fields: dict[str, str] = field(default_factory=dict)
    groups: dict[str, Column] = field(default_factory=dict)
    dims: dict[str, Column] = field(default_factory=dict)
    vector: str | None = None
    word_vectors: DataFrame | None = None


def renamed(node: q.Node, s: Setting) -> q.Node:
    """The query with the corpus's own names of fields and columns."""
    f = lambda name: s.fields.get(name, name)
    all_ = lambda xs: tuple(renamed(x, s) for x in xs)
    if isinstance(node, q.Bool):
        return q.Bool(all_(node.must), all_(node.should), all_(node.must_not), all_(node.filter), node.least)
    if isinstance(node, q.Constant):
        return q.Constant(renamed(node.query, s), node.score)
    if isinstance(node, q.DisMax):
        return q.DisMax(all_(node.queries), node.tie)
    if isinstance(node, q.Combined):
        return q.Combined(node.terms, tuple((f(n), w) for n, w in node.fields))
    if hasattr(node, "column"):
        return type(node)(**{**node.__dict__, "column": s.columns.get(node.column, node.column)})
    if hasattr(node, "field"):
        return type(node)(**{**node.__dict__, "field": f(node.field)})
    return node


def _knn_of(node: q.Node) -> tuple[q.Knn | None, tuple[q.Node, ...]]:
    """A vector query and the filters around it."""
    if isinstance(node, q.Knn):
        return node, ()
    if isinstance(node, q.Bool) and len(node.must) == 1 and isinstance(node.must[0], q.Knn):
        return node.must[0], node.filter
    return None, ()


def _query_vector(s: Setting, node: q.Knn) -> list[float] | None:
    """The stated numbers, or the unit sum of the unit vectors of the stated words; None if none is known."""
    if node.vector:
        return list(node.vector)
    rows = s.word_vectors.where(F.col("word").isin(*node.words)).select("word", "v").collect()
    known = {r["word"]: np.asarray(r["v"], float) for r in rows}
    own = [known[w] / (np.linalg.norm(known[w]) or 1.0) for w in node.words if w in known]
    total = np.sum(own, axis=0) if own else None
    return None if total is None else list(map(float, total / (np.linalg.norm(total) or 1.0)))


def _knn(s: Setting, node: q.Knn, filters: tuple[q.Node, ...], pre: bool, top: int) -> DataFrame:
    corpus, spark = s.corpus, s.corpus.docs.sparkSession
    wanted = _query_vector(s, node)
    docs = corpus.docs
    kept = filters and (pre or None)
    if kept:
        for x in filters:
            docs = docs.where(planner.match(x))
    one = spark.createDataFrame([(0, wanted)] if wanted is not None else [], "query_id long, v array<double>").withColumnRenamed("v", s.vector)
    near = vectors.knn(docs.select(corpus.id, s.vector), one, top, "dot", corpus.id, s.vector, "query_id")
    if filters and not pre:
        columns = docs
        for x in filters:
            columns = columns.where(planner.match(x))
        near = near.join(columns.select(corpus.id), corpus.id, "left_semi")
    return near.select(corpus.id, F.round("score", 6).alias("score"))


def execute(s: Setting, request: q.Request | str) -> DataFrame:
    """Run one request; a line of text is parsed first."""
    r = dsl.parse(request) if isinstance(request, str) else request
    corpus, key, top = s.corpus, s.corpus.id, r.top
    node = renamed(r.query, s)
    if r.respell is not None:
        return collect.respell(corpus.dictionary("body").select("term", "df"), r.respell.lower())
    knn, filters = _knn_of(node)
    if knn is not None:
        return _knn(s, knn, filters, r.pre_filter, top)
    if r.facets:
        return _facets(s, r, node)
    if r.count:
        return planner.count(corpus, node)
    if r.highlight:
        best = planner.search(corpus, node, top).select(key)
        own = corpus.docs.join(best, key, "left_semi")
        return collect.highlight(own, key, corpus.fields["body"], sorted({t for _, t in planner.terms_of(node)}))
    if r.group:
        rows = planner.scored(corpus, node).select(key, "score", s.groups[r.group].alias("group"))
        best = collect.group_top(rows, "group", [F.desc("score"), F.col(key)], F.col("score"), 10, 10)
        return best.select("group", key, "score", "group_rank")
    if r.sort:
        column = s.columns.get(r.sort, r.sort)
        hits = planner.hits(corpus, node).select(key, F.col(column).alias("sort_value")).where("sort_value is not null")
        if r.after is not None:
            hits = hits.where(F.col("sort_value") > F.lit(r.after))
        return collect.sort_by(hits, [F.col("sort_value")], key, top)
    return planner.search(corpus, node, top)


def _facets(s: Setting, r: q.Request, node: q.Node) -> DataFrame:
    """(dim, label, count) of the ten largest labels of every facet asked for, in one pass over the hits."""
    asked = list(dict.fromkeys(spec.rpartition(":")[2] for spec in r.facets))
    dims = {d: s.dims.get(d, F.col(s.columns.get(d, d))).cast("string") for d in asked}
    if r.drill_sideways and r.drill_down:
        for d, _ in r.drill_down:
            dims.setdefault(d, s.dims.get(d, F.col(s.columns.get(d, d))).cast("string"))
        hits = planner.hits(s.corpus, node).select(*[c.alias(d) for d, c in dims.items()])
        return facets.drill_sideways(hits, {d: list(v) for d, v in r.drill_down}, list(dims))
    hits = planner.hits(s.corpus, node).select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), c.alias("label")) for d, c in dims.items()])).alias("x"))
    return facets.top_labels(hits.select("x.*").where("label is not null"), 10)
