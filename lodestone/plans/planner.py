"""From query nodes to Columns.

A match is a predicate and a score an expression over where a document has the query's terms. Over
a plain ``Corpus`` both look at the token arrays of a scan; over an ``Index`` (see ``index``) at the
postings of the query's own terms, and nothing else is read. The collection's statistics
(documents, average length, document frequencies of the query's terms) are one small row.
"""

from __future__ import annotations

import re
from contextvars import ContextVar
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import frequency, positions, tokens
from lodestone.plans import spec as q

K1, B = 1.2, 0.75
PATTERNS = (q.Prefix, q.Wildcard, q.Fuzzy)


@dataclass
class Corpus:
    """Documents with an id column and analysed text fields.

    ``fields`` maps a field name to its text column; the token arrays are made in the scan.
    """

    docs: DataFrame
    id: str
    fields: dict[str, str]
    _stats: dict = field(default_factory=dict)

    def analysed(self) -> DataFrame:
        return self.docs.withColumns({f"__{f}": tokens(F.col(c)) for f, c in self.fields.items()})

    def stats(self, terms: set[tuple[str, str]]) -> dict:
        """Documents and average length by field, document frequency by (field, term); one scan for all."""
        need = {t for t in terms if t not in self._stats}
        if need:
            names = sorted({f for f, _ in need})
            aggs = []
            for f in names:
                aggs += [F.count(f"__{f}").alias(f"n|{f}"), F.coalesce(F.avg(F.size(f"__{f}")), F.lit(0.0)).alias(f"l|{f}")]
            order = sorted(need)
            aggs += [F.coalesce(F.sum(F.array_contains(f"__{f}", t).cast("long")), F.lit(0)).alias(f"d{i}") for i, (f, t) in enumerate(order)]
            sized = self.analysed().select(*[f"__{f}" for f in names])
            row = sized.agg(*aggs).first()
            for f in names:
                self._stats[f] = (row[f"n|{f}"], row[f"l|{f}"])
            self._stats |= {t: row[f"d{i}"] for i, t in enumerate(order)}
        return self._stats


def bm25(tf: Column, length: Column, df: int, n: int, avg: float) -> Column:
    import math

    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    norm = K1 * (1 - B + B * length / F.lit(avg)) if avg else F.lit(K1)
    return F.when(tf > 0, F.lit(idf) * tf / (tf + norm)).otherwise(0.0)


def classic_weight(tf: Column, length: Column, df: int, n: int) -> Column:
    """Square-root frequency, squared inverse document frequency, length norm."""
    import math

    idf = 1 + math.log((n + 1) / (df + 1))
    return F.when(tf > 0, F.sqrt(tf.cast("double")) * F.lit(idf * idf) / F.sqrt(length.cast("double"))).otherwise(0.0)


def terms_of(node: q.Node) -> set[tuple[str, str]]:
    """(field, term) pairs whose statistics the score needs."""
    if isinstance(node, q.Term):
        return {(node.field, node.term)}
    if isinstance(node, (q.Phrase,)):
        return {(node.field, t) for t in node.terms}
    if isinstance(node, q.Combined):
        return {(f, t) for f, _ in node.fields for t in node.terms}
    if isinstance(node, q.Bool):
        return set().union(*[terms_of(x) for x in node.must + node.should])
    if isinstance(node, q.DisMax):
        return set().union(*[terms_of(x) for x in node.queries])
    return set()


#: Within a predicate: the analysed fields as bound variables, see ``hits``.
_BOUND: ContextVar[dict[str, Column] | None] = ContextVar("bound", default=None)


@dataclass
class Posted:
    """Columns that say where a document has terms: frequency (null: nowhere), positions, lengths, and which patterns match."""

    tf: dict[tuple[str, str], Column]
    at: dict[tuple[str, str], Column]
    length: dict[str, Column]
    patterns: dict[q.Node, Column]


#: Within a predicate over postings: their columns.
_POSTED: ContextVar[Posted | None] = ContextVar("posted", default=None)


def _f(name: str) -> Column:
    bound = _BOUND.get()
    return bound[name] if bound is not None else F.col(f"__{name}")


def _at(name: str, group: tuple[str, ...]) -> Column:
    """0-based positions of any of the terms, in order."""
    if posted := _POSTED.get():
        none = F.array().cast("array<int>")
        each = [F.coalesce(posted.at[name, t], none) for t in dict.fromkeys(group)]
        return each[0] if len(each) == 1 else F.array_sort(F.flatten(F.array(*each)))
    return positions(_f(name), list(group))


def _frequency(name: str, term: str) -> Column:
    posted = _POSTED.get()
    return F.coalesce(posted.tf[name, term], F.lit(0)) if posted else frequency(_f(name), term)


def _length(name: str) -> Column:
    posted = _POSTED.get()
    return posted.length[name] if posted else F.size(_f(name))


def fields_of(node: q.Node) -> set[str]:
    """The analysed fields that the match of a query looks at."""
    if isinstance(node, q.Bool):
        return set().union(*[fields_of(x) for x in node.must + node.should + node.must_not + node.filter])
    if isinstance(node, q.DisMax):
        return set().union(*[fields_of(x) for x in node.queries])
    if isinstance(node, q.Constant):
        return fields_of(node.query)
    if isinstance(node, q.Combined):
        return {f for f, _ in node.fields}
    return {node.field} if hasattr(node, "field") else set()


def _or(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, xs)


def _and(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, xs)


def _beyond(at: Column):
    # a lambda of one parameter: Spark would bind a second one to the index
    return lambda x: x > at


def _less(n: int):
    return lambda x: x - n


def _let(values: list[Column], body) -> Column:
    """``body`` over values that are worked out once a row, not once a use: bound as the fields of a struct."""
    bound = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.element_at(F.transform(F.array(bound), lambda s: body([s[f"v{i}"] for i in range(len(values))])), 1)


def _all_there(name: str, groups) -> Column:
    """A cheap first test: every group has a word in the text."""
    if posted := _POSTED.get():
        return _and([_or([posted.tf[name, t].isNotNull() for t in g]) for g in groups])
    return _and([F.arrays_overlap(_f(name), F.array(*[F.lit(t) for t in g])) for g in groups])


def ordered_width(name: str, groups: tuple[tuple[str, ...], ...]) -> Column:
    """Width of the shortest interval that holds the groups in order; null if there is none."""

    def shortest(at: list[Column]) -> Column:
        def width(p: Column) -> Column:
            end = p
            for later in at[1:]:
                end = F.array_min(F.filter(later, _beyond(end)))
            return end - p + 1

        return F.array_min(F.transform(at[0], width))

    return F.when(_all_there(name, groups), _let([_at(name, g) for g in groups], shortest))


def phrase_starts(name: str, groups: tuple[tuple[str, ...], ...]) -> Column:
    """Positions from which the groups stand one after the other."""
    following = list(enumerate(groups[1:], 1))
    if _POSTED.get():
        rest = [(i, _at(name, g)) for i, g in following]
        hit = lambda p: _and([F.array_contains(x, p + i) for i, x in rest] or [F.lit(True)])
    else:
        words = _f(name)
        hit = lambda p: _and([F.coalesce(F.get(words, p + i).isin(*g), F.lit(False)) for i, g in following] or [F.lit(True)])
    return F.filter(_at(name, groups[0]), hit)


def exact_phrase(name: str, groups: tuple[tuple[str, ...], ...]) -> Column:
    """Whether the groups stand at successive positions."""
    return _all_there(name, groups) & (F.size(phrase_starts(name, groups)) > 0)


def phrase_spread(name: str, terms: tuple[str, ...]) -> Column:
    """Smallest spread of displacements over one position for each term; 0 is the exact phrase, null none."""

    def spread(moved: list[Column]) -> Column:
        def over(x: Column) -> Column:
            # with x as the smallest displacement, every other term takes its nearest one from x on
            reach = [F.array_min(F.filter(m, _from(x))) for m in moved]
            whole = reduce(lambda a, b: a & b, [r.isNotNull() for r in reach])
            return F.when(whole, F.greatest(*reach) - x) if len(reach) > 1 else F.lit(0)

        return F.array_min(F.transform(F.flatten(F.array(*moved)), over))

    moved = [F.transform(_at(name, (t,)), _less(i)) for i, t in enumerate(terms)]
    return F.when(_all_there(name, [(t,) for t in terms]), _let(moved, spread))


def _from(x: Column):
    return lambda y: y >= x


def within_edits(word: Column, term: str, edits: int) -> Column:
    """At most ``edits`` insertions, deletions or substitutions; the threshold form stops early."""
    return F.levenshtein(word, F.lit(term), edits) >= 0


def pattern(node: q.Node, word: Column) -> Column:
    """Whether a word is one of a prefix, wildcard or fuzzy query's."""
    if isinstance(node, q.Prefix):
        return F.startswith(word, F.lit(node.prefix))
    if isinstance(node, q.Wildcard):
        like = re.escape(node.pattern).replace(r"\*", ".*").replace(r"\?", ".")
        return word.rlike(f"^(?:{like})$")
    return within_edits(word, node.term, node.edits)


def match(node: q.Node) -> Column:
    """The predicate of a query."""
    posted = _POSTED.get()
    if isinstance(node, q.MatchAll):
        return F.lit(True)
    if isinstance(node, q.Term) and posted:
        return posted.tf[node.field, node.term].isNotNull()
    if isinstance(node, q.Term):
        return F.coalesce(F.array_contains(_f(node.field), node.term), F.lit(False))
    if isinstance(node, q.Bool):
        parts = [match(x) for x in node.must + node.filter] + [~match(x) for x in node.must_not]
        if node.least > 1 or node.least == 1 and node.must:
            parts.append(sum((match(x).cast("int") for x in node.should), F.lit(0)) >= node.least)
        elif node.should and not node.must and (not node.filter or node.least):
            parts.append(_or([match(x) for x in node.should]))
        return _and(parts) if parts else F.lit(False)
    if isinstance(node, q.Constant):
        return match(node.query)
    if isinstance(node, q.Phrase) and not node.slop:
        return F.coalesce(exact_phrase(node.field, tuple((t,) for t in node.terms)), F.lit(False))
    if isinstance(node, q.Phrase):
        return F.coalesce(phrase_spread(node.field, node.terms) <= node.slop, F.lit(False))
    if isinstance(node, q.MultiPhrase):
        return F.coalesce(exact_phrase(node.field, node.terms), F.lit(False))
    if isinstance(node, q.Ordered):
        return F.coalesce(ordered_width(node.field, node.terms) <= node.width, F.lit(False))
    if isinstance(node, q.Near):
        return F.coalesce(ordered_width(node.field, node.terms) - len(node.terms) <= node.slop, F.lit(False))
    if isinstance(node, q.First) and posted:
        return F.coalesce(F.array_min(posted.at[node.field, node.term]) < node.within, F.lit(False))
    if isinstance(node, q.First):
        return F.coalesce(F.array_position(_f(node.field), node.term).between(1, node.within), F.lit(False))
    if isinstance(node, PATTERNS) and posted:
        return F.coalesce(posted.patterns[node], F.lit(False))
    if isinstance(node, PATTERNS):
        return F.coalesce(F.exists(_f(node.field), lambda w: pattern(node, w)), F.lit(False))
    if isinstance(node, q.Range):
        c = F.col(node.column)
        bounds = ([c >= node.low] if node.low is not None else []) + ([c <= node.high] if node.high is not None else [])
        return F.coalesce(_and(bounds or [c.isNotNull()]), F.lit(False))
    if isinstance(node, q.OneOf):
        return F.coalesce(F.col(node.column).isin(*node.values), F.lit(False))
    if isinstance(node, q.Exists):
        return F.col(node.column).isNotNull()
    if isinstance(node, q.Sampled):
        return sampled(F.col(node.column), node.percent)
    if isinstance(node, q.DisMax):
        return _or([match(x) for x in node.queries])
    if isinstance(node, q.Combined):
        return _or([match(q.Term(t, f)) for t in node.terms for f, _ in node.fields])
    raise TypeError(f"no match for {type(node).__name__}")


def sampled(ordinal: Column, percent: float) -> Column:
    """Ordinals k*i + (31*k mod i) of stride i = int(100 / percent)."""
    stride = max(1, int(100.0 / percent))
    k = F.floor(ordinal / stride)
    return ordinal == k * stride + F.pmod(31 * k, F.lit(stride))


def score(node: q.Node, stats: dict) -> Column:
    """The relevance of a matching row."""
    if isinstance(node, q.Term):
        n, avg = stats[node.field]
        tf, length, df = _frequency(node.field, node.term), _length(node.field), stats[(node.field, node.term)]
        kind = stats.get("similarity", "bm25")
        own = classic_weight(tf, length, df, n) if kind == "classic" else F.when(tf > 0, 1.0).otherwise(0.0) if kind == "boolean" else bm25(tf, length, df, n, avg)
        return F.coalesce(own, F.lit(0.0))
    if isinstance(node, q.Phrase):
        # an exact phrase's frequency with the sum of its terms' weights
        import math

        n, avg = stats[node.field]
        idf = sum(math.log(1 + (n - stats[(node.field, t)] + 0.5) / (stats[(node.field, t)] + 0.5)) for t in node.terms)
        found = F.size(phrase_starts(node.field, tuple((t,) for t in node.terms)))
        tf = F.when(found > 0, found.cast("double")).otherwise(1.0 / (1 + phrase_spread(node.field, node.terms)))
        return F.coalesce(F.lit(idf) * tf / (tf + K1 * (1 - B + B * _length(node.field) / F.lit(avg or 1.0))), F.lit(0.0))
    if isinstance(node, q.Bool):
        return sum((F.when(match(x), score(x, stats)).otherwise(0.0) for x in node.must + node.should), F.lit(0.0))
    if isinstance(node, q.DisMax):
        each = [F.when(match(x), score(x, stats)).otherwise(0.0) for x in node.queries]
        best = F.greatest(*each) if len(each) > 1 else each[0]
        return best + node.tie * (sum(each, F.lit(0.0)) - best)
    if isinstance(node, q.Combined):
        import math

        out = F.lit(0.0)
        length = sum((w * F.coalesce(_length(f), F.lit(0)) for f, w in node.fields), F.lit(0.0))
        avg = sum(w * stats[f][1] for f, w in node.fields)
        n = max(stats[f][0] for f, _ in node.fields)
        for t in node.terms:
            df = max(stats[(f, t)] for f, _ in node.fields)
            tf = sum((w * F.coalesce(_frequency(f, t), F.lit(0)) for f, w in node.fields), F.lit(0.0))
            out = out + F.when(tf > 0, F.lit(math.log(1 + (n - df + 0.5) / (df + 0.5))) * tf / (tf + K1 * (1 - B + B * length / F.lit(avg or 1.0)))).otherwise(0.0)
        return out
    if isinstance(node, q.Constant):
        return F.lit(node.score)
    return F.lit(1.0)


def conjuncts(node: q.Node) -> list[q.Node]:
    """Parts that must all match; what can't be split stays whole."""
    if isinstance(node, q.Bool) and not node.should and not node.must_not and node.must + node.filter:
        return [y for x in node.must + node.filter for y in conjuncts(x)]
    if isinstance(node, q.Bool) and node.filter and node.must + node.should:
        return [q.Bool(node.must, node.should, node.must_not, (), node.least), *[y for x in node.filter for y in conjuncts(x)]] if node.must or node.least else [node]
    return [node]


def hits(corpus: Corpus, node: q.Node) -> DataFrame:
    """Matching documents; Catalyst drops what the caller does not use.

    Conditions on plain columns stand alone and reach the scan. Conditions on words are put as one
    expression that binds the token arrays first: pushed down as it is, a bare reference would be
    replaced by the analysis itself at every place where it is used.
    """
    if isinstance(corpus, Corpus) and hasattr(corpus, "postings"):
        return corpus.hits(node)
    parts = conjuncts(node)
    out = corpus.docs
    for x in parts:
        if not fields_of(x):
            out = out.where(match(x))
    out = Corpus(out, corpus.id, corpus.fields).analysed()
    for x in parts:
        if names := sorted(fields_of(x)):
            out = out.where(_let([F.col(f"__{f}") for f in names], lambda bound, x=x, names=names: _bound_match(x, dict(zip(names, bound)))))
    return out


def _bound_match(node: q.Node, fields: dict[str, Column]) -> Column:
    token = _BOUND.set(fields)
    try:
        return match(node)
    finally:
        _BOUND.reset(token)


def scored(corpus: Corpus, node: q.Node, similarity: str = "bm25") -> DataFrame:
    """The matching documents with a column ``score``."""
    need = terms_of(node)
    stats = (corpus.stats(need) if need else {}) | {"similarity": similarity}
    if hasattr(corpus, "postings"):
        return corpus.hits(node, stats)
    return hits(corpus, node).withColumn("score", F.round(score(node, stats), 6))


def search(corpus: Corpus, node: q.Node, top: int | None = 100, similarity: str = "bm25") -> DataFrame:
    """(id, score): the best documents; equal rounded scores by id. ``similarity``: bm25, classic or boolean, for terms."""
    if hasattr(corpus, "postings"):
        need = terms_of(node)
        found = corpus.found(node, (corpus.stats(need) if need else {}) | {"similarity": similarity}).select(corpus.id, "score")
    else:
        found = scored(corpus, node, similarity).select(corpus.id, "score")
    return found.orderBy(F.desc("score"), corpus.id).limit(top) if top is not None else found


def ids(corpus: Corpus, node: q.Node) -> DataFrame:
    """(id) of the matching documents."""
    return (corpus.found(node) if hasattr(corpus, "postings") else hits(corpus, node)).select(corpus.id)


def count(corpus: Corpus, node: q.Node) -> DataFrame:
    """(hit_count): of one term, its document frequency."""
    if hasattr(corpus, "postings") and isinstance(node, q.Term):
        return corpus.dictionary(node.field).where(F.col("term") == node.term).agg(F.coalesce(F.sum("df"), F.lit(0)).alias("hit_count"))
    return ids(corpus, node).agg(F.count("*").alias("hit_count"))
