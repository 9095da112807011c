"""Mixing sources to target weights.

The size of a mix is the largest at which every source that is there can take its share without
repeating a document more often than allowed. A source's documents are dealt by hash to ``FINE``
times as many cells as it has blocks, and the cells packed to blocks of nearly equal tokens, the
same for all sources, so that shards of equally many blocks are of equal size. A source's quota is met by whole passes over its blocks and one partial pass, each in a random
permutation of its own. Whole blocks
are taken in permuted order, the block in which the quota ends only up to it.

The blocks are dealt to output shards by a splitting tree: every node halves its shards and draws
from the multivariate hypergeometric distribution how many blocks of each source go left, until a
shard is left with its exact quota of blocks of each source. The blocks of a shard are disjoint
stretches of the sources' block permutations, the largest put where least is yet, and its documents
are shuffled within it. The number
of shards follows from the size of the largest mix, so a shard, which one task orders, is bounded.

The catalogue that the driver sees has at most ``MOST_BLOCKS * FINE`` rows and one a source, whatever
the documents.

Defined results: null doc_ids, null sources and documents of no tokens are left out; a doc_id
that occurs again counts once. Targets that are null, not positive, or of a source that is not
there (or holds no tokens) take nothing, and their share falls to the others in proportion; the
report shows them with an actual share of 0. Caps below 1 or null take nothing either.
"""

from __future__ import annotations

import heapq
from math import floor

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.encode import token_counts
from lodestone.runtime import materialise

#: Blocks a shard of the smallest mix, cells a block, and blocks of all sources at most.
BLOCKS, FINE, MOST_BLOCKS = 16, 4, 1 << 18
#: Tokens of one output shard, about, and the bounds of the number of shards.
SHARD_TOKENS, LEAST_SHARDS, MOST_SHARDS = 50_000_000, 16, 1024


def splitting_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): how many of each source's blocks each shard gets; columns sum to counts."""
    out = np.zeros((shards, len(counts)), dtype=np.int64)

    def split(left: int, right: int, have: np.ndarray) -> None:
        if right - left == 1:
            out[left] = have
            return
        middle = (left + right) // 2
        total = int(have.sum())
        share = total * (middle - left) / (right - left)
        take = floor(share) + int(rng.random() < share - floor(share))
        part = rng.multivariate_hypergeometric(have, take, method="marginals") if total else have
        split(left, middle, part)
        split(middle, right, have - part)

    split(0, shards, counts.astype(np.int64))
    return out


def _sized(documents: DataFrame, path: str) -> DataFrame:
    """source, doc_id, tokens: once materialised, as everything else starts from it."""
    own = documents.where("doc_id is not null and source is not null").dropDuplicates(["doc_id"]).select("doc_id", "source", "text")
    sizes = token_counts(own.select(F.struct("doc_id", "source").alias("k"), "text"), "k", "text", path)
    return materialise(sizes.select("k.doc_id", "k.source", "tokens").where("tokens > 0"))


def packed(cells: list, blocks: dict[str, int]) -> dict[tuple[str, int], int]:
    """(source, cell): block, so that the blocks of a source have nearly equal tokens: the largest cell to the lightest block."""
    own: dict[str, list] = {}
    for r in cells:
        own.setdefault(r["source"], []).append((-r["tokens"], r["cell"]))
    out = {}
    for source, sizes in own.items():
        heap = [(0, b) for b in range(blocks[source])]
        for tokens, cell in sorted(sizes):
            have, b = heapq.heappop(heap)
            out[source, cell] = b
            heapq.heappush(heap, (have - tokens, b))
    return out


def totals(size: dict[str, int], targets: list) -> dict[str, float]:
    """The tokens of each mix: the most at which every source can take its share."""
    out = {}
    for mix in {t["mix_id"] for t in targets if t["mix_id"] is not None}:
        fit = {}
        for t in targets:
            if t["mix_id"] == mix and t["source"] is not None:
                fit.setdefault(t["source"], t)
        fit = {s: t for s, t in fit.items() if (t["target_share"] or 0) > 0 and (t["max_repeats"] or 0) > 0 and size.get(s, 0) > 0}
        weight = sum(t["target_share"] for t in fit.values())
        if fit:
            out[mix] = min(t["max_repeats"] * size[s] * weight / t["target_share"] for s, t in fit.items())
    return out


def plan(catalogue: list, targets: list, shards: int, seed: int) -> tuple[list[tuple], list[tuple]]:
    """(draws, report). A draw: mix_id, source, pass, block, shard, limit (tokens; null: the whole block)."""
    blocks: dict[str, dict[int, int]] = {}
    for r in catalogue:
        blocks.setdefault(r["source"], {})[r["block"]] = r["tokens"]
    size = {s: sum(b.values()) for s, b in blocks.items()}
    draws, report = [], []
    for mix in sorted({t["mix_id"] for t in targets if t["mix_id"] is not None}):
        own = {}
        for t in targets:
            if t["mix_id"] == mix and t["source"] is not None:
                own.setdefault(t["source"], t)
        fit = {s: t for s, t in own.items() if (t["target_share"] or 0) > 0 and (t["max_repeats"] or 0) > 0 and size.get(s, 0) > 0}
        weight = sum(t["target_share"] for t in fit.values())
        total = min((t["max_repeats"] * size[s] * weight / t["target_share"] for s, t in fit.items()), default=0.0)
        rng = np.random.default_rng([seed, *mix.encode()])
        units: list[list[tuple]] = []
        for s, t in sorted(fit.items()):
            quota = round(total * t["target_share"] / weight)
            mine, turn = [], 1
            while quota > 0 and turn <= t["max_repeats"]:
                for b in rng.permutation(sorted(blocks[s])):
                    if quota <= 0:
                        break
                    n = blocks[s][int(b)]
                    mine.append((mix, s, turn, int(b), None, None if n <= quota else int(quota)))
                    quota -= n
                turn += 1
            units.append([mine[i] for i in rng.permutation(len(mine))])
        shares = splitting_tree(np.array([len(u) for u in units], dtype=np.int64), shards, rng) if units else np.zeros((0, 0), int)
        # which of a source's blocks fill its places in the shards: the largest go where least is yet
        room, have = shares.astype(np.int64), np.zeros(shards)
        for n, k, u in sorted(((u[5] or blocks[u[1]][u[3]], k, u) for k, mine in enumerate(units) for u in mine), key=lambda x: -x[0]):
            shard = int(np.argmin(np.where(room[:, k] > 0, have, np.inf)))
            room[shard, k] -= 1
            have[shard] += n
            draws.append((*u[:4], shard, u[5]))
        report += [(mix, s, float(t["target_share"]) if t["target_share"] is not None else None, t["max_repeats"], float(t["target_share"] / weight) if s in fit else 0.0) for s, t in sorted(own.items())]
    return draws, report


DRAW = "mix_id string, source string, repeat_no int, block int, shard int, quota long"
REPORT = "mix_id string, source string, target_share double, max_repeats int, fair_share double"


def mix(documents: DataFrame, targets: DataFrame, path: str, shards: int | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The choice (mix_id, shard, position, doc_id, source, repeat_no, tokens) and the report of shares."""
    spark = documents.sparkSession
    sized = _sized(documents, path)
    wanted = [r.asDict() for r in targets.collect()]
    own = sized.join(targets.select("source").where("source is not null").distinct(), "source", "left_semi")
    size = {r["source"]: r["tokens"] for r in own.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    sums = totals(size, wanted)
    shards = shards or int(np.clip(np.ceil(max(sums.values(), default=0.0) / SHARD_TOKENS), LEAST_SHARDS, MOST_SHARDS))
    unit = max(min(sums.values(), default=1.0) / (shards * BLOCKS), sum(size.values()) / MOST_BLOCKS, 1.0)
    blocks = {s: max(1, round(n / unit)) for s, n in size.items()}
    counts = spark.createDataFrame(list(blocks.items()), "source string, blocks int")
    own = own.join(counts, "source").withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.col("blocks").cast("long") * FINE).cast("int")).drop("blocks")
    cells = own.groupBy("source", "cell").agg(F.sum("tokens").alias("tokens")).collect()
    place = packed(cells, blocks)
    catalogue: dict[tuple[str, int], int] = {}
    for r in cells:
        key = r["source"], place[r["source"], r["cell"]]
        catalogue[key] = catalogue.get(key, 0) + r["tokens"]
    draws, report = plan([{"source": s, "block": b, "tokens": n} for (s, b), n in catalogue.items()], wanted, shards, seed)
    where = spark.createDataFrame([(s, c, b) for (s, c), b in place.items()], "source string, cell int, block int")
    sized = own.join(where, ["source", "cell"]).drop("cell")
    draw = spark.createDataFrame(draws, DRAW)
    # a draw a block and pass; a block's documents are found by an equi-join
    rows = sized.join(draw, ["source", "block"])
    order = F.xxhash64("doc_id", "mix_id", "repeat_no", F.lit(seed))
    cut = rows.where("quota is not null")
    upto = F.sum("tokens").over(Window.partitionBy("mix_id", "source", "repeat_no", "block").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    # the document that crosses the quota is taken if more than half of it lies within
    cut = cut.withColumn("upto", upto).where(F.col("upto") - F.col("tokens") / 2 <= F.col("quota")).drop("upto")
    chosen = rows.where("quota is null").unionByName(cut)
    place = F.row_number().over(Window.partitionBy("mix_id", "shard").orderBy(F.xxhash64("doc_id", "repeat_no", "mix_id", F.lit(seed + 1)), "doc_id", "repeat_no"))
    chosen = chosen.select("mix_id", "shard", place.alias("position"), "doc_id", "source", "repeat_no", "tokens")
    return chosen, spark.createDataFrame(report, REPORT)


def shares(chosen: DataFrame, report: DataFrame) -> DataFrame:
    """The report with the tokens, rows and actual share of every source of every mix."""
    got = chosen.groupBy("mix_id", "source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"), F.max("repeat_no").alias("most_repeats"))
    all_ = got.groupBy("mix_id").agg(F.sum("tokens").alias("mix_tokens"))
    out = report.join(got, ["mix_id", "source"], "left").join(all_, "mix_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    actual = F.coalesce(F.col("tokens") / F.col("mix_tokens"), F.lit(0.0)).alias("actual_share")
    return out.select("mix_id", "source", "target_share", "fair_share", actual, zero("tokens"), zero("rows"), "max_repeats", zero("most_repeats"))
