"""An index on disk: analysed documents, postings and dictionary, written once and read by term.

``stored`` holds the documents with their token arrays, ``postings`` a row for each (field, term,
document) with frequency, positions and the fields' lengths, ``terms`` the dictionary and ``fields`` the
collection's sizes. Postings lie in folders by a hash of the term and are sorted by (term,
document) within; they are range partitioned before they are written, so the postings of a very
frequent term are many files of like size, and those of a rare one a page of a file. A query reads
the folders of its own terms only, and of those the pages that hold them; documents are looked up
by an equi-join of the hits.

Inverting takes one pass over the tokens in Arrow batches, linear in their number, however long a
text is. An index belongs to the files it was made from: its name is made of their paths, sizes
and times.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import tokens
from lodestone.plans import planner
from lodestone.plans import spec as q
from lodestone.runtime import _forget, machine_local, shared_dir

#: Tokens of one folder of postings, about; and the bounds of the number of folders.
TOKENS_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 20_000_000, 8, 4096
#: Tokens inverted at a time.
SLICE = 2_000_000
#: Terms of a pattern that are asked for by name; with more the pattern itself is asked of the postings.
MOST_EXPANSIONS = 1024
#: Goes into the name; to be raised when the files' layout changes.
LAYOUT = 2
_OPEN: dict[str, Index] = {}


def _invert(fields: list[str]):
    """(id, __field...) to (field, term, doc, tf, positions, l_field...); l_ is the length of each field of the document, null where it has none."""

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = sum(np.nan_to_num(pa.compute.list_value_length(batch.column(i + 1)).to_numpy(zero_copy_only=False).astype(float)) for i in range(len(fields)))
        part = (np.cumsum(sizes) // SLICE).astype(int)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                lengths = [pa.compute.list_value_length(batch.column(i + 1)) for i in range(len(fields))]
                for i, name in enumerate(fields):
                    lists = batch.column(i + 1)
                    size = lengths[i].fill_null(0).to_numpy()
                    flat = lists.flatten().dictionary_encode()
                    if not len(flat):
                        continue
                    doc = np.repeat(np.arange(len(size)), size)
                    pos = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
                    key = doc * len(flat.dictionary) + flat.indices.to_numpy()
                    order = np.argsort(key, kind="stable")
                    first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
                    tf = np.diff(np.r_[first, len(order)])
                    own = doc[order[first]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(first)), flat.dictionary.take(flat.indices.take(pa.array(order[first]))), batch.column(0).take(pa.array(own)), pa.array(tf, pa.int32()),
                         pa.ListArray.from_arrays(pa.array(np.r_[first, len(order)], pa.int32()), pa.array(pos[order], pa.int32())), *[x.take(pa.array(own)) for x in lengths]],
                        names=["field", "term", "doc", "tf", "positions", *[f"l_{f}" for f in fields]])

    return work


def build(docs: DataFrame, id_col: str, fields: dict[str, str], path: str) -> None:
    """Write the index of ``docs``; ``fields`` maps a field to its text column."""
    spark = docs.sparkSession
    docs.withColumns({f"__{f}": tokens(F.col(c)) for f, c in fields.items()}).write.parquet(f"{path}/stored")
    stored = spark.read.parquet(f"{path}/stored")
    names = list(fields)
    sizes = stored.agg(*[x for f in names for x in (F.count(f"__{f}").alias(f"n_{f}"), F.coalesce(F.sum(F.size(f"__{f}")).cast("long"), F.lit(0)).alias(f"t_{f}"))]).first()
    buckets = int(np.clip(sum(sizes[f"t_{f}"] or 0 for f in names) // TOKENS_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS))
    kind = stored.schema[id_col].dataType.simpleString()
    flat = stored.select(id_col, *[f"__{f}" for f in names]).mapInArrow(_invert(names), f"field string, term string, doc {kind}, tf int, positions array<int>" + "".join(f", l_{f} int" for f in names))
    order = ["bucket", "field", "term", "doc"]
    flat = flat.withColumn("bucket", bucket_of(F.col("term"), buckets)).repartitionByRange(*order).sortWithinPartitions(*order)
    flat.write.partitionBy("bucket").parquet(f"{path}/postings")
    words = spark.read.parquet(f"{path}/postings").groupBy("bucket", "field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))
    words.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.parquet(f"{path}/terms")
    rows = [(f, sizes[f"n_{f}"], int(sizes[f"t_{f}"] or 0), buckets) for f in names]
    spark.createDataFrame(rows, "field string, docs long, tokens long, buckets int").coalesce(1).write.parquet(f"{path}/fields")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def positional(node: q.Node) -> set[tuple[str, str]]:
    """(field, term) pairs whose positions a match or score looks at."""
    if isinstance(node, q.Phrase):
        return {(node.field, t) for t in node.terms}
    if isinstance(node, (q.MultiPhrase, q.Ordered, q.Near)):
        return {(node.field, t) for g in node.terms for t in g}
    if isinstance(node, q.First):
        return {(node.field, node.term)}
    return set().union(*[positional(x) for x in children(node)])


def children(node: q.Node) -> tuple[q.Node, ...]:
    if isinstance(node, q.Bool):
        return node.must + node.should + node.must_not + node.filter
    if isinstance(node, q.DisMax):
        return node.queries
    return (node.query,) if isinstance(node, q.Constant) else ()


def named_terms(node: q.Node) -> set[tuple[str, str]]:
    """All (field, term) pairs that a query names."""
    own: set[tuple[str, str]] = positional(node) if not children(node) else set()
    if isinstance(node, q.Term):
        own = {(node.field, node.term)}
    if isinstance(node, q.Combined):
        own = {(f, t) for f, _ in node.fields for t in node.terms}
    return own.union(*[named_terms(x) for x in children(node)])


def patterns_of(node: q.Node) -> list[q.Node]:
    if isinstance(node, planner.PATTERNS):
        return [node]
    return list(dict.fromkeys(p for x in children(node) for p in patterns_of(x)))


def columns_of(node: q.Node) -> set[str]:
    """Stored columns that a query looks at."""
    own = {node.column} if isinstance(node, (q.Range, q.OneOf, q.Exists, q.Sampled)) else set()
    return own.union(*[columns_of(x) for x in children(node)])


def without_words(node: q.Node) -> bool:
    """Whether a document that has none of the query's words may match."""
    if isinstance(node, q.Bool):
        must = node.must + node.filter
        if node.least or (node.should and not must):
            return all(map(without_words, must)) and any(map(without_words, node.should))
        return all(map(without_words, must)) if must else not node.should and bool(node.must_not)
    if isinstance(node, q.DisMax):
        return any(map(without_words, node.queries))
    if isinstance(node, q.Constant):
        return without_words(node.query)
    return isinstance(node, (q.MatchAll, q.Range, q.OneOf, q.Exists, q.Sampled))


class Index(planner.Corpus):
    """A corpus whose words are read from postings. ``same_as_id``: a column that has the id's value."""

    def __init__(self, spark: SparkSession, path: str, id_col: str, fields: dict[str, str], same_as_id: tuple[str, ...] = ()):
        super().__init__(spark.read.parquet(f"{path}/stored"), id_col, fields)
        self.postings = spark.read.parquet(f"{path}/postings")
        self.words = spark.read.parquet(f"{path}/terms")
        self.sizes = {r["field"]: r for r in spark.read.parquet(f"{path}/fields").collect()}
        self.buckets = next(iter(self.sizes.values()))["buckets"]
        self.same_as_id = {id_col, *same_as_id}

    def analysed(self) -> DataFrame:
        return self.docs

    def dictionary(self, field: str) -> DataFrame:
        """(term, df, ttf) of a field."""
        return self.words.where(F.col("field") == field).select("term", "df", "ttf")

    def stats(self, terms: set[tuple[str, str]]) -> dict:
        """Documents and average length by field, document frequency by (field, term); a look at the dictionary."""
        need = {t for t in terms if t not in self._stats}
        if need:
            asked = self.words.where(F.col("term").isin(*sorted({t for _, t in need})) & F.col("field").isin(*sorted({f for f, _ in need})))
            df = {(r["field"], r["term"]): r["df"] for r in asked.collect()}
            self._stats |= {t: df.get(t, 0) for t in need}
            for f in {f for f, _ in need}:
                n, tokens_ = self.sizes[f]["docs"], self.sizes[f]["tokens"]
                self._stats[f] = (n, tokens_ / n if n else 0.0)
        return self._stats

    def found(self, node: q.Node, stats: dict | None = None, keep: bool = False) -> DataFrame:
        """(id), with ``score`` if ``stats`` are given, of the matching documents; with ``keep`` their stored columns."""
        parts = planner.conjuncts(node)
        plain = [x for x in parts if not planner.fields_of(x)]
        worded = [x for x in parts if planner.fields_of(x)]
        extra = set().union(*[columns_of(x) for x in worded], set()) - self.same_as_id
        everything = all(map(without_words, worded))
        on_id = [x for x in plain if columns_of(x) <= self.same_as_id and columns_of(x)]
        rest = [x for x in plain if x not in on_id]
        stored = self.docs
        for x in rest:
            stored = stored.where(planner.match(x))
        if worded:
            posted, rows = self._posted(q.Bool(must=(node,)) if stats is not None else q.Bool(must=tuple(worded)))
        else:
            posted, rows = planner.Posted({}, {}, {}, {}), None
        needed = rest or extra or everything or keep or any(not isinstance(x, q.MatchAll) for x in rest)
        if rows is None:
            rows = stored
        elif needed:
            columns = stored if keep else stored.select(self.id, *sorted(extra))
            rows = columns.join(rows.drop(*(self.same_as_id - {self.id})), self.id, "left" if everything else "inner")
        for c in self.same_as_id - set(rows.columns):
            rows = rows.withColumn(c, F.col(self.id))
        for x in on_id:
            rows = rows.where(planner.match(x))
        token = planner._POSTED.set(posted)
        try:
            for x in worded:
                rows = rows.where(planner.match(x))
            if stats is not None:
                rows = rows.withColumn("score", F.round(planner.score(node, stats), 6))
        finally:
            planner._POSTED.reset(token)
        inner = [c for c in rows.columns if c.startswith("__p_")]
        return rows.drop(*inner) if keep else rows.select(self.id, *(["score"] if stats is not None else []))

    def hits(self, node: q.Node, stats: dict | None = None) -> DataFrame:
        """The matching documents with all stored columns."""
        return self.found(node, stats, keep=True)

    def _posted(self, node: q.Node) -> tuple[planner.Posted, DataFrame]:
        """A row a document that has any of the query's words, with what is known of them there."""
        terms, places = sorted(named_terms(node)), positional(node)
        patterns = patterns_of(node)
        field, term = F.col("field"), F.col("term")
        conditions, lists = [], {}
        for p in patterns:
            known = [r["term"] for r in self.words.where((field == p.field) & planner.pattern(p, term)).select("term").limit(MOST_EXPANSIONS + 1).collect()]
            lists[p] = known if len(known) <= MOST_EXPANSIONS else None
            conditions.append((field == p.field) & (term.isin(*known) if known else F.lit(False)) if lists[p] is not None else (field == p.field) & planner.pattern(p, term))
        wanted = list(conditions)
        for f in sorted({f for f, _ in terms}):
            wanted.append((field == f) & term.isin(*[t for g, t in terms if g == f]))
        rows = self.postings
        if all(x is not None for x in lists.values()):
            # by folder first: the hashes are of the query's own words
            own = sorted({t for _, t in terms} | {t for x in lists.values() for t in x})
            hashes = self._buckets(own)
            rows = rows.where(F.col("bucket").isin(*hashes) if hashes else F.lit(False))
        rows = rows.where(planner._or(wanted) if wanted else F.lit(False))
        names = list(self.fields)
        if len(terms) == 1 and not patterns:
            (f, t), = terms
            rows = rows.select(F.col("doc").alias(self.id), F.col("tf").alias("__p_t0"), F.col("positions").alias("__p_a0"), *[F.col(f"l_{f}").alias(f"__p_l_{f}") for f in names])
        else:
            is_ = lambda f, t: (field == f) & (term == t)
            aggs = [F.max(F.when(is_(*x), F.col("tf"))).alias(f"__p_t{i}") for i, x in enumerate(terms)]
            aggs += [F.max(F.when(is_(*x), F.col("positions"))).alias(f"__p_a{i}") for i, x in enumerate(terms) if x in places]
            aggs += [F.max(c).alias(f"__p_m{i}") for i, c in enumerate(conditions)]
            aggs += [F.max(f"l_{f}").alias(f"__p_l_{f}") for f in names]
            rows = rows.groupBy(F.col("doc").alias(self.id)).agg(*aggs)
        posted = planner.Posted(
            {x: F.col(f"__p_t{i}") for i, x in enumerate(terms)}, {x: F.col(f"__p_a{i}") for i, x in enumerate(terms) if x in places},
            {f: F.col(f"__p_l_{f}") for f in names}, {p: F.col(f"__p_m{i}") for i, p in enumerate(patterns)})
        return posted, rows

    def _buckets(self, terms: list[str]) -> list[int]:
        if not terms:
            return []
        spark = self.docs.sparkSession
        hashed = spark.range(1).select(F.array(*[bucket_of(F.lit(t), self.buckets) for t in terms]).alias("b"))
        return sorted(set(hashed.first()["b"]))


def fingerprint(docs: DataFrame) -> str:
    """Of the files that a table is read from: their names, sizes and times."""
    spark = docs.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = hashlib.sha256()
    for name in sorted(docs.inputFiles()):
        at = jvm.org.apache.hadoop.fs.Path(name)
        status = at.getFileSystem(conf).getFileStatus(at)
        out.update(f"{name} {status.getLen()} {status.getModificationTime()};".encode())
    return out.hexdigest()[:24]


def open_index(name: str, docs: DataFrame, id_col: str, fields: dict[str, str], same_as_id: tuple[str, ...] = ()) -> Index:
    """The index of ``docs`` in the shared folder, built where it is not there yet.

    On a cluster it stays for later applications; a test's goes with its temporary folder.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/index{LAYOUT}-{name}-{fingerprint(docs)}"
    key = f"{spark.sparkContext.applicationId} {path}"
    if key not in _OPEN:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        if not fs.exists(at):
            made = f"{path}-{uuid.uuid4().hex}"
            build(docs, id_col, fields, made)
            if not fs.rename(jvm.org.apache.hadoop.fs.Path(made), at) and not fs.exists(at):
                raise OSError(f"no index at {path}")
        if machine_local(spark):
            atexit.register(_forget, spark, path)
        _OPEN[key] = Index(spark, path, id_col, fields, same_as_id)
    return _OPEN[key]
