"""Most similar vectors for every vector: inverted lists with an adaptive dimension scan.

k-means centroids, fitted on a bounded sample, divide all vectors into lists. A vector asks the
lists of its nearest centroids, as many as it takes for ``recall`` of the sample's own nearest
neighbours to lie in them: those of all vectors lie nearer still, so what is measured on the sample
is on the safe side. Within a list the vectors are rotated by a random
orthogonal matrix and compared in blocks of columns: after each block a hypothesis test on the
partial distance (Gao and Long, adaptive sampling) abandons the pairs that will not come within
the wanted distance. What is left is measured exactly in double precision.

Equal vectors are collapsed to one representative first, so a vector that a third of all rows
share is looked up once; a row's best are then put together from its own class and its class's
neighbours. Lists expected to be large are dealt out in parts, and their visitors in pieces; each
part meets each piece in a task of its own. Two different vectors of one hash value are noticed, and
another hash is taken.

Defined results: a vector that is null, of another length, all zero or not wholly finite is left
out, as are null ids; rows with equal id count once; ties go to the smaller id; empty tables give
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.runtime import group_codes, materialise, whole_groups

#: Columns compared at a time, and the test's strictness (larger: fewer wrongly abandoned).
BLOCK = 16
EPSILON = 2.1
#: The index is fitted on SAMPLE_A_LIST vectors a list, FIT_ROWS at most; every vector is indexed.
SAMPLE_A_LIST, FIT_ROWS, MAX_LISTS, ROUNDS = 32, 262_144, 16_384, 6
#: Vectors of one list that one task compares; a larger list is dealt out over several.
PART_ROWS, PIECE_ROWS = 8192, 32_768
TILE = 1024
#: Centroids compared at a time, and rows that leave a routing task at a time.
LIST_TILE, SLICE_ROWS = 2048, 100_000
#: Vectors of the sample whose neighbours tell how many lists must be asked; and the least number.
ASKED, LEAST_PROBES = 512, 4
#: Rows that give a first bound; share of a tile's pairs below which candidates are worked on one by one.
SEED_ROWS, DENSE = 256, 0.05


def usable(vector: str, dim: int) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # keeps the squares from leaving the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit_lists(sample: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of the (unit) sample by k-means, and the share of the sample in each list."""
    rng = np.random.default_rng(1)
    lists = min(lists, len(sample))
    centre = sample[rng.choice(len(sample), lists, replace=False)].astype(np.float32)
    sample = sample.astype(np.float32)
    for step in range(ROUNDS + 1):
        near = np.concatenate([nearest(sample[i : i + 8192], centre, 1)[:, 0] for i in range(0, len(sample), 8192)])
        if step == ROUNDS:
            break
        order = np.argsort(near, kind="stable")
        first = np.flatnonzero(np.r_[True, near[order][1:] != near[order][:-1]])
        centre[near[order][first]] = np.add.reduceat(sample[order], first, axis=0) / np.diff(np.r_[first, len(near)])[:, None]
    return centre, np.bincount(near, minlength=lists) / len(near)


def nearest(x: np.ndarray, centre: np.ndarray, m: int) -> np.ndarray:
    """The m nearest centroids of each row, nearest first; centroids are taken some at a time."""
    m = min(m, len(centre))
    best_d, best_i = np.zeros((len(x), 0), np.float32), np.zeros((len(x), 0), np.int32)
    for lo in range(0, len(centre), LIST_TILE):
        tile = centre[lo : lo + LIST_TILE]
        d = np.c_[best_d, (tile * tile).sum(1)[None, :] - 2 * x @ tile.T]
        i = np.c_[best_i, np.broadcast_to(np.arange(lo, lo + len(tile), dtype=np.int32), (len(x), len(tile)))]
        if d.shape[1] > m:
            some = np.argpartition(d, m - 1, axis=1)[:, :m]
            d, i = np.take_along_axis(d, some, 1), np.take_along_axis(i, some, 1)
        best_d, best_i = d, i
    return np.take_along_axis(best_i, np.argsort(best_d, axis=1, kind="stable"), 1)


def probes_for(sample: np.ndarray, centre: np.ndarray, k: int, least: float, recall: float) -> int:
    """Lists to ask so that ``recall`` of the sample's k nearest neighbours (with cosine >= least) are in them."""
    sample = sample.astype(np.float32)
    asked = np.random.default_rng(2).choice(len(sample), min(ASKED, len(sample)), replace=False)
    home = np.concatenate([nearest(sample[i : i + 8192], centre, 1)[:, 0] for i in range(0, len(sample), 8192)])
    ranks = []
    for lo in range(0, len(asked), 32):
        own = asked[lo : lo + 32]
        cos = sample[own] @ sample.T
        cos[np.arange(len(own)), own] = -9
        near = np.argpartition(-cos, min(k, cos.shape[1] - 1), axis=1)[:, :k]
        good = np.take_along_axis(cos, near, 1) >= max(least, -1.5)
        place = np.argsort(nearest(sample[own], centre, len(centre)), axis=1)
        ranks.append(np.take_along_axis(place, home[near], 1)[good])
    ranks = np.sort(np.concatenate(ranks))
    if not len(ranks):
        return LEAST_PROBES
    return max(LEAST_PROBES, int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1)


def scan(query: np.ndarray, base: np.ndarray, same: np.ndarray, k: int, least: float, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, base, cosine) of each query's up to k most similar base rows with cosine >= least.

    ``same`` names the base row that is the query itself, or -1. Rows are unit vectors in double
    precision; ties go to the smaller base row, so base rows come in order of their ids.
    """
    dim = query.shape[1]
    q32, b32 = (query @ turn).astype(np.float32), (base @ turn).astype(np.float32)
    blocks = list(range(0, dim, BLOCK))
    tau = np.full(len(query), 2 - 2 * least + 1e-6, np.float32)
    if len(base) > k:
        # the k-th best among some rows bounds every query's distance from the start
        seed = q32 @ b32[: max(SEED_ROWS, 4 * k)].T
        known = np.flatnonzero((same >= 0) & (same < seed.shape[1]))
        seed[known, same[known]] = -9
        if seed.shape[1] > k:
            tau = np.minimum(tau, 2 - 2 * np.partition(seed, -k, axis=1)[:, -k] + 1e-5)
    best_q, best_b, best_s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    for lo in range(0, len(base), TILE):
        tile = b32[lo : lo + TILE]
        part, i = None, None
        for b in blocks:
            stop = min(b + BLOCK, dim)
            if i is None or len(i) > DENSE * part.size:
                # many candidates are left: the whole tile by one multiplication
                x, y = q32[:, b:stop], tile[:, b:stop]
                more = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
                part = more if part is None else part + more
                live = part <= _bound(tau, stop, dim)[:, None]
                i, j = np.nonzero(live)
                got = None
            else:
                diff = q32[i, b:stop] - tile[j, b:stop]
                got = (part[i, j] if got is None else got) + np.einsum("ij,ij->i", diff, diff)
                keep = got <= _bound(tau[i], stop, dim)
                i, j, got = i[keep], j[keep], got[keep]
        if len(i) > DENSE * part.size:
            # hardly anything was abandoned: all of the tile exactly, then the best k and what ties with them
            whole = query @ base[lo : lo + TILE].T
            mine = np.flatnonzero((same >= lo) & (same < lo + len(tile)))
            whole[mine, same[mine] - lo] = -9
            floor = np.full(len(query), least)
            if whole.shape[1] > k:
                floor = np.maximum(floor, np.partition(whole, -k, axis=1)[:, -k])
            i, j = np.nonzero(whole >= floor[:, None])
            cos, j = whole[i, j], j + lo
        else:
            j = j + lo
            other = same[i] != j
            i, j = i[other], j[other]
            cos = np.einsum("ij,ij->i", query[i], base[j])
        keep = cos >= least
        best_q, best_b, best_s = np.r_[best_q, i[keep]], np.r_[best_b, j[keep]], np.r_[best_s, cos[keep]]
        order = np.lexsort((best_b, -best_s, best_q))
        best_q, best_b, best_s = best_q[order], best_b[order], best_s[order]
        rank = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
        best_q, best_b, best_s, rank = (x[rank < k] for x in (best_q, best_b, best_s, rank))
        full = rank == k - 1
        tau[best_q[full]] = np.minimum(tau[best_q[full]], 2 - 2 * best_s[full] + 1e-6)
    return best_q, best_b, best_s


def _bound(tau: np.ndarray, d: int, dim: int) -> np.ndarray:
    """The largest partial distance over d columns that the test lets pass."""
    return tau + 1e-5 if d >= dim else tau * (d / dim) * (1 + EPSILON / np.sqrt(d)) ** 2 + 1e-5


def classes(docs: DataFrame, id_col: str, vector: str, dim: int, seed: int = 42) -> DataFrame:
    """(h, id, v): usable vectors, a row an id; h is equal for equal vectors."""
    own = docs.where(F.col(id_col).isNotNull() & usable(vector, dim)).select(F.col(id_col).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    return own.withColumn("h", F.xxhash64("v", F.lit(seed))).groupBy("h", "id").agg(F.first("v").alias("v"))


def _representatives(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h").agg(F.min("id").alias("id"), F.min_by("v", "id").alias("v"))


def _search(reps: DataFrame, queries: DataFrame | None, n: int, dim: int, k: int, least: float, probes: float | None, recall: float) -> DataFrame:
    """(q, b, cos, b_id): for the classes of ``queries`` (all if None) their k best other classes of the ``n``."""
    spark = reps.sparkSession
    lists = int(np.clip(round(np.sqrt(n)), 1, MAX_LISTS))
    want = min(SAMPLE_A_LIST * lists, FIT_ROWS)
    part = F.pmod(F.xxhash64("h", F.lit(5)), F.lit(1 << 40))
    sample = reps.where(part < F.lit(int(min(1.0, want / max(1, n)) * (1 << 40)) + 1)).select("v").limit(2 * want).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "q long, b long, cos double, b_id string")
    sample = unit(_matrix(sample.column("v"), dim))
    centre, share = fit_lists(sample, lists)
    parts = np.maximum(1, np.ceil(share * n / PART_ROWS)).astype(int)
    if probes is None:
        m = min(len(centre), probes_for(sample, centre, k, least, recall))
    else:
        m = int(min(len(centre), probes if probes >= 1 else max(8, np.ceil(probes * len(centre)))))
    # how many visitors a list is to expect, from the sample
    some = sample[:: max(1, len(sample) // 8192)].astype(np.float32)
    step = max(1, 2_000_000 // m)
    visits = sum(np.bincount(nearest(some[i : i + step], centre, m).ravel(), minlength=len(centre)) for i in range(0, len(some), step)) / len(some)
    asking = n if queries is None else queries.count()
    pieces = np.maximum(1, np.ceil(visits * asking / PIECE_ROWS)).astype(int)
    index = spark.sparkContext.broadcast((centre, parts, pieces))
    turn = rotation(dim)

    def route(role_base: bool, role_query: bool):
        """Rows (list, part, piece, kind): 0 in the list only, 1 in it and asking, 2 asking only."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centre, parts, pieces = index.value
            step = max(1, SLICE_ROWS // (m if role_query else 1))
            for whole in batches:
                for lo in range(0, whole.num_rows, step):
                    yield from routed(whole.slice(lo, step), centre, parts, pieces)

        def routed(batch, centre, parts, pieces) -> Iterator[pa.RecordBatch]:
            h = batch.column("h").to_numpy()
            near = nearest(unit(_matrix(batch.column("v"), dim)).astype(np.float32), centre, m if role_query else 1)
            mix = h.astype(np.uint64)
            part = (mix >> np.uint64(20)).astype(np.int64) % parts[near[:, 0]]
            row, column = np.divmod(np.arange(near.size), near.shape[1])
            at = near.ravel()
            piece = (mix >> np.uint64(36)).astype(np.int64)[row] % pieces[at]
            out = []
            if role_base:
                # a vector stands in one part of its list, before every piece of its visitors
                home = near[:, 0]
                times = pieces[home]
                who = np.repeat(np.arange(len(h)), times)
                turn_ = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                own = role_query & (turn_ == ((mix >> np.uint64(36)).astype(np.int64) % times)[who])
                out.append((who, home[who], part[who], turn_, np.where(own, 1, 0)))
            if role_query:
                times = parts[at]
                who = np.repeat(np.arange(near.size), times)
                turn_ = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                ask = np.ones(len(who), bool)
                if role_base:
                    ask = (column[who] > 0) | (turn_ != part[row[who]])
                who, turn_ = who[ask], turn_[ask]
                out.append((row[who], at[who], turn_, piece[who], np.full(len(who), 2)))
            rows, lists_, part_, piece_, kind = (np.concatenate(x) for x in zip(*out))
            for lo in range(0, len(rows), SLICE_ROWS):
                cut = slice(lo, lo + SLICE_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists_[cut], pa.int32()), pa.array(part_[cut], pa.int32()), pa.array(piece_[cut], pa.int32()), pa.array(kind[cut], pa.int32()), *batch.select(["id", "h", "v"]).take(pa.array(rows[cut])).columns],
                    names=["list", "part", "piece", "kind", "id", "h", "v"])

        return work

    keys = ["list", "part", "piece"]
    shape = "list int, part int, piece int, kind int, id string, h long, v array<float>"
    if queries is None:
        routed = reps.select("id", "h", "v").mapInArrow(route(True, True), shape)
    else:
        routed = reps.select("id", "h", "v").mapInArrow(route(True, False), shape).unionByName(queries.select("id", "h", "v").mapInArrow(route(False, True), shape))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            code = group_codes(table, keys)
            x = unit(_matrix(table.column("v"), dim))
            kind, h = table.column("kind").to_numpy(), table.column("h").to_numpy()
            ids = table.column("id").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True])
            for a, b in zip(cuts[:-1], cuts[1:]):
                base, query = a + np.flatnonzero(kind[a:b] < 2), a + np.flatnonzero(kind[a:b] > 0)
                if not len(base) or not len(query):
                    continue
                order = np.argsort(h[base])
                at = np.minimum(np.searchsorted(h[base], h[query], sorter=order), len(base) - 1)
                same = np.where(h[base[order[at]]] == h[query], order[at], -1)
                for q0 in range(0, len(query), 4096):
                    some = query[q0 : q0 + 4096]
                    i, j, s = scan(x[some], x[base], same[q0 : q0 + 4096], k, least, turn)
                    yield pa.RecordBatch.from_arrays([pa.array(h[some[i]]), pa.array(h[base[j]]), pa.array(s), pa.array(ids[base[j]], pa.string())], names=["q", "b", "cos", "b_id"])

    found = routed.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(search, "q long, b long, cos double, b_id string")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cos"), "b_id"))
    return found.withColumn("r", best).where(F.col("r") <= k).drop("r")


def most_similar(docs: DataFrame, k: int = 5, least: float = -1.0, probes: float | None = None, recall: float = 0.97, dim: int = 64, id_col: str = "id", vector: str = "vector", asking: Column | None = None) -> DataFrame:
    """(id, other, cosine): for each id its up to k most similar other ids with cosine >= least.

    ``probes``: lists asked for each vector, or below 1 the share of all lists; None takes as many as
    the sample shows to be needed for ``recall``. ``asking`` is a
    condition on ``id``; without it every vector asks. Linear in the rows, whatever the copies:
    a row of n equal ones gets k of the others, not all.
    """
    for seed in range(42, 50):
        rows = materialise(classes(docs, id_col, vector, dim, seed))
        alike = rows.groupBy("h").agg((F.min("v") != F.max("v")).alias("clash")).agg(F.count("*"), F.max("clash")).first()
        if not alike[1]:
            break
    reps = _representatives(rows)
    # the k + 1 smallest ids of a class, by salted parts first so that a hot class is many tasks' work
    salted = Window.partitionBy("h", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    heads = rows.select("h", "id").withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    heads = heads.groupBy("h").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("head"))
    asked = None if asking is None else _representatives(rows.where(asking))
    near = _search(reps, asked, alike[0], dim, k, least, probes, recall)
    pick = lambda cos, ids: F.transform(ids, lambda i: F.struct((-cos).alias("s"), i.alias("other")))
    far = near.join(heads, near.b == heads.h).groupBy("q").agg(F.flatten(F.collect_list(pick(F.col("cos"), F.col("head")))).alias("far"))
    askers = rows.select("h", "id") if asking is None else rows.where(asking).select("h", "id")
    none = F.array().cast("array<struct<s:double,other:string>>")
    own = heads.where(F.size("head") > 1).select("h", pick(F.lit(1.0), F.col("head")).alias("own"))
    both = own.join(far, own.h == far.q, "full").select(F.coalesce("h", "q").alias("h"), F.slice(F.array_sort(F.concat(F.coalesce("own", none), F.coalesce("far", none))), 1, 2 * k + 1).alias("best"))
    out = askers.join(both, "h").select("id", F.explode(F.slice(F.filter("best", lambda x: x["other"] != F.col("id")), 1, k)).alias("x"))
    return out.select("id", "x.other", (-F.col("x.s")).alias("cosine")).where(F.col("cosine") >= least)


def similar_pairs(docs: DataFrame, k: int, least: float, **options) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of which one is among the other's k most similar."""
    near = most_similar(docs, k, least, **options)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
