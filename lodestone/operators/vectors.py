"""Vector operators: similarities, exact k-nearest search, quantisation, quality checks.

Exact search multiplies blocks of vectors with a matrix of queries in Arrow batches, keeps k a
task and query, and ranks those; the vectors themselves never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one pass over the vectors; more are taken in blocks of so many.
MAX_QUERIES = 4096
#: Scores that a task holds at a time.
MAX_SCORES = 2_000_000
METRICS = ("dot", "cosine", "euclidean", "mip", "angular")


def dot(a: Column, b: Column) -> Column:
    """In double precision, element by element in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    return F.transform(a, lambda x: F.when(norm(a) > 0, x.cast("double") / norm(a)).otherwise(x.cast("double")))


def scale_clip(a: Column, factor: float, low: int = -128, high: int = 127) -> Column:
    return F.transform(a, lambda x: F.greatest(F.least(F.round(x.cast("double") * factor), F.lit(float(high))), F.lit(float(low))).cast("int"))


def similarity(a: Column, b: Column, metric: str) -> Column:
    """The score maps of the four metrics; angular is another name of dot."""
    if metric in ("dot", "angular"):
        return (1 + dot(a, b)) / 2
    if metric == "cosine":
        return (1 + dot(a, b) / (norm(a) * norm(b))) / 2
    if metric == "euclidean":
        diff = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
        return 1 / (1 + dot(diff, diff))
    if metric == "mip":
        d = dot(a, b)
        return F.when(d >= 0, 1 + d).otherwise(1 / (1 - d))
    raise ValueError(metric)


def _scores(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    d = x @ q.T
    if metric in ("dot", "angular"):
        return (1 + d) / 2
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return (1 + d / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :])) / 2
    if metric == "euclidean":
        return 1 / (1 + np.maximum(0, (x * x).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * d))
    if metric == "mip":
        return np.where(d >= 0, 1 + d, 1 / (1 - np.minimum(d, 0)))
    raise ValueError(metric)


def knn(docs: DataFrame, queries: DataFrame, k: int, metric: str = "dot", key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", least: float | None = None, parent: str | None = None) -> DataFrame:
    """(query, key, score): the k best of every query, ties to the smaller key; null vectors and undefined scores drop out.

    With ``least`` every vector that reaches the score is given instead of the k best; with
    ``parent`` the best vector of each parent (query, key, parent, score), and no k.
    """
    rows = queries.where(F.col(vector).isNotNull()).select(query_key, vector).collect()
    blocks = [rows[i : i + MAX_QUERIES] for i in range(0, len(rows), MAX_QUERIES)] or [[]]
    found = None
    for some in blocks:
        part = _knn_block(docs, some, queries.schema[query_key].dataType.simpleString(), k, metric, key, vector, query_key, least, parent)
        found = part if found is None else found.unionByName(part)
    if parent is not None:
        best = F.row_number().over(Window.partitionBy(query_key, parent).orderBy(F.desc("score"), key))
        return found.withColumn("rank", best).where(F.col("rank") == 1).drop("rank")
    if least is not None:
        return found
    best = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return found.withColumn("rank", best).where(F.col("rank") <= k)


def _knn_block(docs: DataFrame, rows: list, query_type: str, k: int, metric: str, key: str, vector: str, query_key: str, least: float | None, parent: str | None) -> DataFrame:
    names = [r[0] for r in rows]
    matrix = np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), -1)
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix))
    columns = [key, *([parent] if parent is not None else [])]
    schema = f"{query_key} {query_type}, " + "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in columns) + "score double"
    step = max(1, MAX_SCORES // max(1, len(rows)))

    def pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
        for batch in batches:
            v = batch.column(0)
            fits = np.flatnonzero(pa.compute.equal(pa.compute.list_value_length(v), width).fill_null(False).to_numpy(zero_copy_only=False))
            for i in range(0, len(fits), step):
                at = pa.array(fits[i : i + step])
                yield v.take(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width), [c.take(at) for c in batch.columns[1:]]

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        if not len(ids):
            return
        ids = pa.array(ids)
        held: list[pa.Array] = []  # the values of columns
        hj, hs = np.zeros(0, np.int64), np.zeros(0)  # their queries and scores
        floor = np.full(len(q), -np.inf if least is None else least)
        out = lambda j, values, s: pa.RecordBatch.from_arrays([ids.take(pa.array(j)), *values, pa.array(s)], names=[query_key, *columns, "score"])
        for x, values in pieces(batches, q.shape[1]):
            s = np.round(_scores(x, q, metric), 9)
            s[np.isnan(s)] = -np.inf
            low = floor
            if least is None and parent is None and len(s) > k:
                low = np.maximum(floor, np.partition(s, len(s) - k, axis=0)[len(s) - k])
            i, j = np.nonzero((s >= low) & (s > -np.inf))
            if parent is not None:  # the rows of a parent together, the best of each
                code = values[1].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                order = np.lexsort((np.unique(values[0].to_numpy(zero_copy_only=False), return_inverse=True)[1], code))
                starts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
                i = np.concatenate([order[a:b][s[order[a:b]].argmax(axis=0)] for a, b in zip(starts, [*starts[1:], len(order)])])
                j = np.tile(np.arange(len(q)), len(starts))
                i, j = i[ok := s[i, j] > -np.inf], j[ok]
            new = [c.take(pa.array(i)) for c in values]
            if least is not None:
                yield out(j, new, s[i, j])
                continue
            held = [pa.concat_arrays([a, b]) for a, b in zip(held, new)] if held else new
            hj, hs = np.r_[hj, j], np.r_[hs, s[i, j]]
            # the best k of each query, or of each query and parent, stay
            tie = np.unique(held[0].to_numpy(zero_copy_only=False), return_inverse=True)[1]
            group = held[1].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) if parent is not None else np.zeros(len(hj), np.int64)
            order = np.lexsort((tie, -hs, group, hj))
            oj, og = hj[order], group[order]
            first = np.flatnonzero(np.r_[True, (np.diff(oj) != 0) | (np.diff(og) != 0)][: len(oj)])
            nth = np.arange(len(oj)) - np.repeat(first, np.diff(np.r_[first, len(oj)]))
            order = order[nth < (k if parent is None else 1)]
            held, hj, hs = [c.take(pa.array(order)) for c in held], hj[order], hs[order]
            if parent is None:
                full = np.bincount(hj, minlength=len(q)) >= k
                floor = np.full(len(q), -np.inf)
                np.minimum.at(worst := np.full(len(q), np.inf), hj, hs)
                floor[full] = worst[full]
        if held:
            yield out(hj, held, hs)

    return docs.where(F.col(vector).isNotNull()).select(vector, *columns).mapInArrow(block, schema)


def best_per_parent(scored: DataFrame, query_key: str, parent: str, k: int) -> DataFrame:
    """(query, parent, score): children rolled up to the best score of each parent."""
    up = scored.groupBy(query_key, parent).agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), parent))
    return up.withColumn("rank", best).where(F.col("rank") <= k)


def quantised(vector: Column, bits: int, low: float = -1.0, high: float = 1.0) -> Column:
    """Linear quantiser to ``bits`` bits, given back on the original scale."""
    levels = (1 << bits) - 1
    step = (high - low) / levels
    return F.transform(vector, lambda x: (F.round((F.least(F.greatest(x.cast("double"), F.lit(low)), F.lit(high)) - low) / step) * step + low).cast("float"))


def rerank(docs: DataFrame, queries: DataFrame, k: int, oversample: float, bits: int, metric: str = "dot", key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """k best by exact score among the k * oversample best by quantised vectors."""
    rough = docs.select(key, quantised(F.col(vector), bits).alias(vector))
    candidates = knn(rough, queries, int(k * oversample), metric, key, vector, query_key).select(query_key, key)
    own = candidates.join(docs.select(key, F.col(vector).alias("__v")), key).join(queries.select(query_key, F.col(vector).alias("__q")), query_key)
    exact = own.select(query_key, key, F.round(similarity(F.col("__v"), F.col("__q"), metric), 9).alias("score"))
    best = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return exact.withColumn("rank", best).where(F.col("rank") <= k)


def recall(found: DataFrame, truth: DataFrame, query_key: str, key: str) -> DataFrame:
    """One row: hits among the truth over the truth; a (query, key) that occurs twice counts once."""
    t, f = truth.select(query_key, key).distinct(), found.select(query_key, key).distinct().withColumn("hit", F.lit(1))
    return t.join(f, [query_key, key], "left").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


def dimension_stats(docs: DataFrame, vector: str) -> DataFrame:
    """Per dimension: n, mean, stdev, zeros, skewness, kurtosis."""
    flat = docs.select(F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return flat.groupBy("dim").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("stdev"), F.sum((F.col("x") == 0).cast("long")).alias("zeros"),
        F.skewness("x").alias("skewness"), F.kurtosis("x").alias("kurtosis"))


def drift(a: DataFrame, b: DataFrame, vector: str) -> DataFrame:
    """Per dimension: z of the means' difference and ratio of the spreads of two sets."""
    x = dimension_stats(a, vector).select("dim", F.col("mean").alias("ma"), F.col("stdev").alias("sa"), F.col("n").alias("na"))
    y = dimension_stats(b, vector).select("dim", F.col("mean").alias("mb"), F.col("stdev").alias("sb"), F.col("n").alias("nb"))
    z = (F.col("ma") - F.col("mb")) / F.sqrt(F.col("sa") ** 2 / F.col("na") + F.col("sb") ** 2 / F.col("nb"))
    return x.join(y, "dim").select("dim", z.alias("z"), (F.col("sb") / F.col("sa")).alias("spread_ratio"))


def overlap(a: DataFrame, b: DataFrame, vector: str) -> DataFrame:
    """One row: vectors of a that occur in b, and repeated vectors within each; by hash, then by value."""
    count = lambda d: d.where(F.col(vector).isNotNull()).groupBy(F.xxhash64(vector).alias("h"), vector).agg(F.count("*").alias("n"))
    x, y = count(a).select("h", vector, F.col("n").alias("na")), count(b).select("h", vector, F.col("n").alias("nb"))
    both = x.join(y, ["h", vector], "full")
    more = lambda c: F.coalesce(F.sum(F.when(F.col(c) > 1, F.col(c) - 1)), F.lit(0))
    return both.agg(F.coalesce(F.sum(F.when(F.col("nb").isNotNull(), F.col("na"))), F.lit(0)).alias("shared"), more("na").alias("repeats_a"), more("nb").alias("repeats_b"))


def hadamard(docs: DataFrame, key: str, vector: str, dim: int, inverse: bool = False, seed: int = 0) -> DataFrame:
    """Seeded block rotation: sign flips, a permutation and fast Walsh-Hadamard transforms, or its inverse.

    The blocks are the powers of two that the dimension is the sum of; vectors of another length become null.
    """
    rng = np.random.default_rng([dim, seed])
    sign, order = rng.choice([-1.0, 1.0], dim), rng.permutation(dim)
    blocks = [1 << i for i in reversed(range(dim.bit_length())) if dim >> i & 1]

    def transform(x: np.ndarray) -> np.ndarray:
        out, at = np.empty_like(x), 0
        for block in blocks:
            y, h = x[:, at : at + block], 1
            while h < block:
                y = y.reshape(-1, block // (2 * h), 2, h)
                y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(-1, block)
                h *= 2
            out[:, at : at + block] = y / np.sqrt(block)
            at += block
        return out

    def turn(x: np.ndarray) -> np.ndarray:
        if not inverse:
            return transform((x * sign)[:, order])
        back = np.empty_like(x)
        back[:, order] = transform(x)
        return back * sign

    @F.pandas_udf("array<double>")
    def rotate(v: pd.Series) -> pd.Series:
        fits = v.map(lambda x: x is not None and len(x) == dim).to_numpy(bool)
        out: list = [None] * len(v)
        if fits.any():
            for i, row in zip(np.flatnonzero(fits), turn(np.stack(v[fits].to_list()).astype(np.float64))):
                out[i] = row
        return pd.Series(out, dtype=object)

    return docs.select(key, rotate(F.col(vector)).alias(vector))


def intrinsic_dimension(docs: DataFrame, queries: DataFrame, vector: str, key: str, k: int = 10, tail: float = 0.1) -> DataFrame:
    """(method, dimension) by two nearest neighbours and by maximum likelihood.

    The neighbours of a stated query set (query_id, vector) are searched among all vectors. Equal
    vectors are no neighbours; the two-neighbour estimate leaves out the ``tail`` largest ratios.
    """
    near = knn(docs, queries, k + 1, "euclidean", key, vector).where(F.col("query_id") != F.col(key))
    near = near.select("query_id", F.sqrt(1 / F.col("score") - 1).alias("d")).where("d > 1e-6")
    w = Window.partitionBy("query_id").orderBy("d")
    near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).withColumn("far", F.max("d").over(Window.partitionBy("query_id"))).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    each = near.groupBy("query_id").agg(F.max(F.when(F.col("r") == 2, F.col("d"))).alias("d2"), F.max(F.when(F.col("r") == 1, F.col("d"))).alias("d1"), F.sum(F.log(F.col("far") / F.col("d"))).alias("s"), F.max("n").alias("n"))
    each = each.where("n > 2").select(F.log(F.col("d2") / F.col("d1")).alias("ratio"), (F.col("s") / (F.col("n") - 2)).alias("inverse"))
    ranked = each.withColumn("p", F.row_number().over(Window.orderBy("ratio"))).withColumn("all", F.count("*").over(Window.partitionBy()))
    kept = ranked.agg(F.sum(F.when(F.col("p") <= F.floor(F.col("all") * (1 - tail)), F.col("ratio"))).alias("s"), F.sum(F.when(F.col("p") <= F.floor(F.col("all") * (1 - tail)), 1)).alias("m"), F.max(F.when(F.col("p") == F.floor(F.col("all") * (1 - tail)), F.col("ratio"))).alias("last"), F.max("all").alias("all"), F.avg("inverse").alias("inverse"))
    # the ratios left out are at least as large as the last one kept
    two = F.col("m") / (F.col("s") + (F.col("all") - F.col("m")) * F.col("last"))
    return kept.select(F.explode(F.array(F.struct(F.lit("two_nn").alias("method"), two.alias("dimension")), F.struct(F.lit("mle").alias("method"), (1 / F.col("inverse")).alias("dimension")))).alias("x")).select("x.*").where("dimension is not null")


def principal_dimension(docs: DataFrame, vector: str, dim: int, share: float = 0.95) -> DataFrame:
    """(method, dimension): the principal components that hold ``share`` of the variance, from sums over all rows."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim + 1, dim + 1)), 0
        for batch in batches:
            v = batch.column(0)
            v = v.filter(pa.compute.equal(pa.compute.list_value_length(v), dim).fill_null(False))
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            x = np.c_[x[np.isfinite(x).all(1)], np.ones(int(np.isfinite(x).all(1).sum()))]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "s"])

    # (dim + 1) squared sums, whatever the rows
    sums = docs.select(vector).mapInArrow(moments, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((dim + 1) * (dim + 1))
    for r in sums:
        total[r["i"]] = r["s"]
    total = total.reshape(dim + 1, dim + 1)
    n = total[-1, -1]
    out = []
    if n > 1:
        mean = total[-1, :-1] / n
        values = np.maximum(0.0, np.linalg.eigvalsh(total[:-1, :-1] / n - np.outer(mean, mean))[::-1])
        out = [("pca", float(np.searchsorted(np.cumsum(values), share * values.sum() * (1 - 1e-12)) + 1))]
    return docs.sparkSession.createDataFrame(out, "method string, dimension double")


def text_vectors(texts: DataFrame, key: str, words: str, dictionary: DataFrame) -> DataFrame:
    """(key, vector): unit sum of the unit vectors of a text's words; ``dictionary`` has word and v."""
    flat = texts.select(key, F.explode(words).alias("word")).join(dictionary.select("word", normalised(F.col("v")).alias("v")), "word")
    parts = flat.select(key, F.posexplode("v").alias("dim", "x")).groupBy(key, "dim").agg(F.sum("x").alias("x"))
    whole = parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("vector"))
    return whole.select(key, normalised(F.col("vector")).alias("vector"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): smallest id that is reachable over undirected edges.

    Rounds of propagation with pointer jumps until nothing changes; a path of n nodes takes about
    log n rounds. The rounds' tables are in the shared folder.
    """
    from lodestone.runtime import materialise

    both = materialise(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    now = materialise(nodes.select("id", F.col("id").alias("component")))
    while True:
        # the least component among the neighbours is told to the node and to its own root
        least = both.join(now, both.dst == now.id).groupBy("src").agg(F.min("component").alias("m"))
        told = now.join(least, now.id == least.src).where("m < component").select("id", "component", "m")
        hints = told.select("id", "m").unionByName(told.select(F.col("component").alias("id"), "m")).groupBy("id").agg(F.min("m").alias("m"))
        step = now.join(hints, "id", "left").select("id", "component", F.least("component", F.coalesce("m", "component")).alias("new"))
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("far"))
        new = materialise(step.join(jump, "new", "left").select("id", F.col("component").alias("old"), F.least("new", F.coalesce("far", "new")).alias("component")))
        now = new.select("id", "component")
        if not new.where("old != component").limit(1).count():
            return now


def sampled_distances(docs: DataFrame, queries: DataFrame, vector: str, key: str) -> DataFrame:
    """(bucket, pairs): histogram of dot products of a stated query set with all vectors, in steps of 0.05."""
    pairs = knn(docs, queries, 0, "dot", key, vector, "query_id", least=float("-inf")).where(F.col("query_id") != F.col(key))
    return pairs.groupBy(F.round(F.floor((F.col("score") * 2 - 1) / 0.05) * 0.05, 2).alias("bucket")).agg(F.count("*").alias("pairs"))


def strong_components(nodes: DataFrame, edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, component): strongly connected components, named by their smallest id.

    Forward and backward minimum labels are propagated among the nodes not yet settled; nodes
    whose two labels agree form components and are taken out, and the rest goes on.
    """
    from lodestone.runtime import materialise

    left, done = materialise(nodes.select("id").distinct()), None
    arcs = materialise(edges.select("src", "dst").where("src != dst").distinct())

    def spread(ids: DataFrame, own: DataFrame, a: str, b: str) -> DataFrame:
        now = materialise(ids.select("id", F.col("id").alias("m")))
        for _ in range(rounds):
            best = own.join(now, F.col(a) == F.col("id")).groupBy(b).agg(F.min("m").alias("n"))
            new = now.join(best, F.col("id") == F.col(b), "left").select("id", F.col("m").alias("old"), F.least("m", F.coalesce("n", "m")).alias("m"))
            new = materialise(new)
            now = new.select("id", "m")
            if not new.where("old != m").limit(1).count():
                return now
        raise RuntimeError(f"not settled after {rounds} rounds")

    for _ in range(rounds):
        if not left.limit(1).count():
            break
        own = arcs.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi")
        both = spread(left, own, "src", "dst").withColumnRenamed("m", "f").join(spread(left, own, "dst", "src").withColumnRenamed("m", "b"), "id")
        both = materialise(both)
        found = both.where("f = b").select("id", F.col("f").alias("component"))
        done = found if done is None else done.unionByName(found)
        left = both.where("f != b").select("id")
    return done if done is not None else nodes.select("id", F.col("id").alias("component")).limit(0)
