"""Near-duplicate records by tensored banding.

A record is the set of its successive word triples (or of ``width`` words). Two small collections
of half-keys are made from minhashes; every pair of a half-key of the first and one of the second
is the key of a table, so ``half * half`` tables need only ``2 * half`` half-keys. Records that
share a key in any table are candidates, and candidates are verified on their exact sets.

Records with the same words are one class and stand in the tables once. The keys are counted before
anything is brought together by them: a bucket of at most ``BUCKET`` classes gives its pairs as
candidates; the classes of larger buckets (a text that many share in part) are joined exactly
instead, and never meet in one task: two sets of similarity s share one of the rarest (1 - s) of
their shingles, so each class is filed under those only, which common passages never are. Where
even such a file is large, its classes really are alike; it is compared block against block, in
parallel, where the sets' sizes allow a pair at all, and only true pairs leave a task. So no partner
is ever cut off.

``near_duplicates`` gives pairs of ids. Every pair of different texts is there. Of the copies of one
text each is paired with the ``COPIES`` that follow it in the class (all pairs up to that size), and
each copy of a text with that many copies of every near text, so the rows stay in proportion to the
ids, by one rule for classes of any size. ``near_duplicate_groups`` gives a row for every id: its
class, the class's size, the number of near texts and the connected group.

Defined results: null title or text counts as empty; records of fewer than ``least_words`` words
and null ids are left out; rows with equal id count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.vectors import components
from lodestone.runtime import group_codes, materialise, whole_groups

WORD = regex.compile(r"[\p{L}\p{N}]+")
#: Half-keys a collection, minhashes a half-key: at similarity s two records meet in some table
#: with probability (1 - (1 - s**MINHASHES)**HALF)**2; 0.6: 0.94, 0.7: 0.99.
HALF, MINHASHES = 8, 2
BUCKET = 32
BLOCK = 1024
COPIES = 64
#: Keys of large buckets are broadcast up to this number (8 bytes each) and joined by shuffle beyond.
MOST_HOT = 1_000_000
CACHE = 500_000


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


class Shingler:
    """Word hashes and shingle hashes of texts; the cache of words is bounded."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def words(self, text: str) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        known, out = self.known, []
        for w in WORD.findall(text.lower()):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)

    def shingles(self, words: np.ndarray) -> np.ndarray:
        n = len(words) - self.width + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for i in range(self.width):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
        return np.unique(h)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0x94D049BB133111EB) ^ (x >> np.uint64(32))


def half_keys(flat: np.ndarray, first: np.ndarray, collections: int) -> np.ndarray:
    """(records, collections * HALF): half-keys of many records, from shingles laid end to end."""
    n = collections * HALF
    mul, add = _seeds(n * MINHASHES)
    out = np.zeros((len(first), n), np.uint64)
    for i in range(n):
        key = np.zeros(len(first), np.uint64)
        for j in range(i * MINHASHES, (i + 1) * MINHASHES):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(mix(flat * mul[j] + add[j]), first))
        out[:, i] = key
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _text(docs: DataFrame, id_col: str, title: str, text: str) -> DataFrame:
    full = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), full.alias("t"))


def _signatures(width: int, least_words: int, collections: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                piece = batch.slice(lo, 1000)
                rows, content, sets = [], [], []
                for i, t in enumerate(piece.column("t").to_pylist()):
                    w = shingler.words(t)
                    if len(w) >= max(least_words, width):
                        rows.append(i)
                        content.append(xxhash.xxh3_64_intdigest(w.tobytes()))
                        sets.append(shingler.shingles(w))
                if not rows:
                    continue
                first = np.cumsum([0, *map(len, sets[:-1])])
                keys = half_keys(np.concatenate(sets), first, collections)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * keys.shape[1], pa.int32()), _signed(keys.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column("id").take(pa.array(rows)), _signed(np.array(content, np.uint64)), lists], names=["id", "h", "keys"])

    return work


def _pairs_of_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): the pairs of the rows of each key, which are ``BUCKET`` at most."""
    for table in whole_groups(batches, ["key"], least=50_000):
        code = group_codes(table, ["key"])
        size = np.bincount(code)[code]
        left, right = [], []
        for shift in range(1, int(size.max(initial=1))):
            a = np.flatnonzero(size > shift)
            a = a[a + shift < len(code)]
            a = a[code[a] == code[a + shift]]
            left.append(a)
            right.append(a + shift)
        if not left:
            continue
        names = table.column("id").to_pandas().to_numpy()
        out = pd.DataFrame({"a": names[np.concatenate(left)], "b": names[np.concatenate(right)]}).drop_duplicates()
        yield pa.RecordBatch.from_arrays([pa.array(out["a"], pa.string()), pa.array(out["b"], pa.string())], names=["a", "b"])


def _bucketed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (id, key): candidate pairs (a, b) of small buckets, and the (id, key) of large ones.

    The counts of the keys are summed before the shuffle; a hot key's rows never move.
    """
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("key")
    hot = materialise(counts)
    few = hot.limit(MOST_HOT + 1).count() <= MOST_HOT
    side = F.broadcast(hot) if few else hot
    small = rows.join(side, "key", "left_anti")
    pairs = small.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_pairs_of_buckets, "a string, b string")
    return pairs, rows.join(side, "key", "left_semi")


def _links(docs: DataFrame, least: float, width: int, least_words: int, id_col: str, title: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """True pairs (a, b) of class representatives, the members (h, id) and the representatives (h, id)."""
    full = _text(docs, id_col, title, text)
    # equal words are one class; partial aggregation leaves a row a class and task of a hot class
    signed = materialise(full.mapInArrow(_signatures(width, least_words, 2), "id string, h long, keys array<long>"))
    reps = signed.groupBy("h").agg(F.min("id").alias("id"), F.min_by("keys", "id").alias("keys"))
    half = lambda c: F.slice("keys", c * HALF + 1, HALF)
    tables = F.flatten(F.transform(half(0), lambda x, i: F.transform(half(1), lambda y, j: F.xxhash64(x, y, i, j))))
    pairs, large = _bucketed(materialise(reps.select("id", "keys")).select("id", F.explode(tables).alias("key")))
    true = _verified(pairs.distinct(), full, width, least)
    hot = materialise(large.select("id").distinct())
    if hot.head(1):
        true = true.unionByName(_exact_pairs(hot, full, width, least))
    return true.distinct(), signed.select("id", "h").distinct(), reps.select("h", "id")


def near_duplicates(docs: DataFrame, least: float = 0.8, width: int = 5, least_words: int = 10, id_col: str = "id", title: str = "title", text: str = "text") -> DataFrame:
    """(id_a, id_b), id_a < id_b: records whose shingle sets have Jaccard similarity >= least; see above for copies."""
    return _with_copies(*_links(docs, least, width, least_words, id_col, title, text))


def near_duplicate_groups(docs: DataFrame, least: float = 0.8, width: int = 5, least_words: int = 10, id_col: str = "id", title: str = "title", text: str = "text") -> DataFrame:
    """(id, class_id, copies, near_texts, group_id), a row an id.

    ``class_id`` is the smallest id with the same words and ``copies`` how many have them,
    ``near_texts`` the number of other texts of similarity >= least, ``group_id`` the smallest id
    that is reached over such links.
    """
    links, members, reps = _links(docs, least, width, least_words, id_col, title, text)
    links = materialise(links)
    group = components(reps.select("id"), links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("near_texts"))
    size = members.groupBy("h").agg(F.count("*").alias("copies"))
    classes = reps.join(size, "h").join(group, "id").join(degree, "id", "left")
    classes = classes.select("h", F.col("id").alias("class_id"), "copies", F.coalesce("near_texts", F.lit(0)).alias("near_texts"), F.col("component").alias("group_id"))
    return members.join(classes, "h").select("id", "class_id", "copies", "near_texts", "group_id")


def _shingle_sets(full: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, s): the shingle hashes of the texts in ``ids``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            sets = [shingler.shingles(shingler.words(t)) for t in batch.column("t").to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _signed(flat))], names=["id", "s"])

    return full.join(ids, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(work, "id string, s array<long>")


def _verified(pairs: DataFrame, full: DataFrame, width: int, least: float) -> DataFrame:
    pairs = materialise(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = _shingle_sets(full, ids, width)
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    # least * union <= intersection, in whole numbers where it can be
    enough = both * F.lit(1.0) >= F.lit(least) * (F.size("sa") + F.size("sb") - both) - F.lit(1e-9)
    return joined.where(enough).select("a", "b")


def _exact_pairs(ids: DataFrame, full: DataFrame, width: int, least: float) -> DataFrame:
    """All true pairs among ``ids`` by the prefix filter, whatever share of the records they are."""
    sets = materialise(_shingle_sets(full, ids, width))
    flat = sets.select("id", F.explode("s").alias("key"))
    rare = flat.groupBy("key").agg(F.count("*").alias("f"))
    order = flat.join(rare.where("f > 1"), "key").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "key"))).alias("by"))
    # shingles of one record only are the rarest; they fill the prefix first and lead nowhere
    own = order.join(sets.select("id", F.size("s").alias("n")), "id")
    prefix = F.col("n") - F.ceil(F.lit(least) * F.col("n") - F.lit(1e-9)) + 1 - (F.col("n") - F.size("by"))
    keyed = own.where(prefix > 0).select("id", F.explode(F.slice("by", F.lit(1), prefix.cast("int"))["key"]).alias("key"))
    pairs, large = _bucketed(materialise(keyed))
    true = _verified(pairs.distinct(), full, width, least)
    if not large.head(1):
        return true
    # buckets with the same members are compared once
    alike = large.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    once = alike.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    return true.unionByName(_block_pairs(large.join(once, "key", "left_semi"), sets, least))


def _block_pairs(hot: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """True pairs within large buckets, block against block.

    Sets whose sizes differ by more than a factor ``least`` can't be alike, so blocks hold sets of
    one size class (a factor of ``1 / least``) and meet those of the same and the next class only.
    """
    own = materialise(hot.select("key", "id").join(sets, "id"))
    step = float(np.log(1.0 / max(min(least, 0.999), 0.01)))
    own = own.withColumn("class", F.floor(F.log(F.size("s").cast("double")) / step + 1e-9))
    size = own.groupBy("key", "class").agg(F.count("*").alias("n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK))
    blocks = size.select("key", "class", parts.alias("parts"))
    own = materialise(own.join(blocks, ["key", "class"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts"))
    names = blocks.select("key", "class", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block")).select("key", F.struct("class", "block").alias("x"))
    other = names.select("key", F.col("x").alias("y"))
    duty = names.join(other, "key").where((F.col("x") <= F.col("y")) & (F.col("y.class") - F.col("x.class") <= 1))
    at = F.struct("class", F.col("block").cast("long").alias("block"))
    own = own.select("key", at.alias("at"), "id", "s")
    one = duty.join(own.withColumnRenamed("at", "x"), ["key", "x"]).select("key", "x", "y", F.lit(0).alias("side"), "id", "s")
    two = duty.where("x < y").join(own.withColumnRenamed("at", "y"), ["key", "y"]).select("key", "x", "y", F.lit(1).alias("side"), "id", "s")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        side, ids = frame["side"].to_numpy(), frame["id"].to_numpy()
        within = not side.any()
        first = np.flatnonzero(side == 0)
        second = first if within else np.flatnonzero(side == 1)
        i, j = alike([np.asarray(frame["s"].iloc[r]) for r in first], [np.asarray(frame["s"].iloc[r]) for r in second], least)
        a, b = ids[first[i]], ids[second[j]]
        keep = a < b if within else np.ones(len(a), bool)
        return pd.DataFrame({"a": np.minimum(a[keep], b[keep]), "b": np.maximum(a[keep], b[keep])})

    return one.unionByName(two).groupBy("key", "x", "y").applyInPandas(compare, "a string, b string").distinct()


def alike(x: list[np.ndarray], y: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the sets of x and y with Jaccard similarity >= least; the sets hold distinct numbers.

    Intersections are counted by multiplying membership matrices, some shingles at a time.
    """
    nx, ny = np.array([len(s) for s in x]), np.array([len(s) for s in y])
    if not len(x) or not len(y):
        return np.zeros(0, int), np.zeros(0, int)
    values, code = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    row = np.repeat(np.arange(len(x) + len(y)), np.r_[nx, ny])
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    both = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, len(values), 4096):
        a, b = np.searchsorted(code, [lo, lo + 4096])
        member = np.zeros((len(x) + len(y), min(4096, len(values) - lo)), np.float32)
        member[row[a:b], code[a:b] - lo] = 1
        both += member[: len(x)] @ member[len(x) :].T
    return np.nonzero(both >= least * (nx[:, None] + ny[None, :] - both) - 1e-6)


def _ranked(members: DataFrame) -> DataFrame:
    """h, id, n, rank: the members of a class numbered from 0; a hot class is numbered in parts."""
    salt = F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")
    own = members.select("h", "id", salt)
    parts = own.groupBy("h", "salt").agg(F.count("*").alias("m"))
    group = Window.partitionBy("h")
    parts = parts.select("h", "salt", F.sum("m").over(group).alias("n"), (F.sum("m").over(group.orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("before"))
    place = F.row_number().over(Window.partitionBy("h", "salt").orderBy("id")) - 1
    return own.withColumn("place", place).join(parts, ["h", "salt"]).select("h", "id", "n", (F.col("before") + F.col("place")).alias("rank"))


def _with_copies(pairs: DataFrame, members: DataFrame, reps: DataFrame) -> DataFrame:
    """From pairs of representatives to pairs of ids."""
    ranked = materialise(_ranked(members).join(reps.select("h", F.col("id").alias("rep")), "h").drop("h"))
    # within a class: each with those that follow it
    copies = ranked.where("n > 1")
    after = F.sequence(F.col("rank") + 1, F.least(F.col("n") - 1, F.col("rank") + COPIES))
    follow = copies.where(F.col("rank") < F.col("n") - 1).select("rep", F.col("id").alias("x"), F.explode(after).alias("rank"))
    within = follow.join(copies.select("rep", "rank", F.col("id").alias("y")), ["rep", "rank"]).select("x", "y")
    # across: each of the larger class with up to COPIES of the smaller, dealt out in turn
    size = ranked.where("rank = 0").select("rep", "n")
    sized = pairs.join(size.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b")
    swap = F.col("na") > F.col("nb")
    sized = sized.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("few"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("rep"), F.least("na", "nb").alias("m"))
    turn = F.pmod(F.col("rank") + F.col("t"), F.col("m"))
    dealt = sized.join(ranked.select("rep", "rank", F.col("id").alias("x")), "rep")
    dealt = dealt.select("few", "x", "rank", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("m"), F.lit(COPIES)) - 1)).alias("t")).select(F.col("few").alias("rep"), "x", turn.alias("rank"))
    across = dealt.join(ranked.select("rep", "rank", F.col("id").alias("y")), ["rep", "rank"]).select("x", "y")
    out = across.unionByName(within)
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
