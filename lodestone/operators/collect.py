"""What is done with hits: top-n, sorts, keyset pages, groups, highlights, suggestions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens


def sort_by(hits: DataFrame, keys: list[Column], key: str, top: int) -> DataFrame:
    """The first ``top`` hits by ``keys``, ties by id. Spark keeps a heap a partition; nothing is sorted as a whole."""
    return hits.orderBy(*keys, key).limit(top)


def search_after(hits: DataFrame, column: str, key: str, value, after_key, top: int) -> DataFrame:
    """The page behind (value, after_key); the condition reaches the scan."""
    c = F.col(column)
    return hits.where((c > value) | ((c == value) & (F.col(key) > after_key))).orderBy(column, key).limit(top)


def group_top(hits: DataFrame, group: str, order: list[Column], best: Column, groups: int, docs: int) -> DataFrame:
    """The best ``docs`` hits of the best ``groups`` groups (by ``best``, then the group's name).

    The groups are found first from partial maxima; only their hits are ranked. A hot group is cut
    down to ``docs`` rows a salt before it is ranked as one.
    """
    hits = hits.where(F.col(group).isNotNull())
    leaders = hits.groupBy(group).agg(F.max(best).alias("group_best")).orderBy(F.desc("group_best"), group).limit(groups)
    # at most ``groups`` rows on the leaders' side
    kept = hits.join(F.broadcast(leaders), group)
    salted = Window.partitionBy(group, F.spark_partition_id()).orderBy(*order)
    kept = kept.withColumn("__r", F.row_number().over(salted)).where(F.col("__r") <= docs)
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return kept.withColumn("group_rank", rank).where(F.col("group_rank") <= docs).drop("__r")


def term_stats(docs: DataFrame, text: str) -> DataFrame:
    """(term, df, ttf): document and total frequencies; combined before the shuffle."""
    each = docs.select(tokens(F.col(text)).alias("w")).where("w is not null")
    df = each.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ttf = each.select(F.explode("w").alias("term")).groupBy("term").agg(F.count("*").alias("ttf"))
    return df.join(ttf, "term")


def document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """(term, df)."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, doc, tf, positions)."""
    flat = docs.select(F.col(key).alias("doc"), F.posexplode(tokens(F.col(text))).alias("pos", "term"))
    return flat.groupBy("term", "doc").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def respell(dictionary: DataFrame, term: str, edits: int = 2, top: int = 10) -> DataFrame:
    """More frequent terms within ``edits`` edits, nearest and most frequent first."""
    own = dictionary.where(F.col("term") == term).agg(F.coalesce(F.max("df"), F.lit(0)).alias("m")).first()["m"]
    d = F.levenshtein(F.col("term"), F.lit(term), edits)
    near = dictionary.withColumn("distance", d).where((F.col("distance") > 0) & (F.col("df") > own))
    return near.orderBy("distance", F.desc("df"), "term").limit(top).select("term", "distance", "df")


def suggest(dictionary: DataFrame, prefix: str, top: int = 10) -> DataFrame:
    """Most frequent completions of a prefix."""
    return dictionary.where(F.startswith("term", F.lit(prefix))).orderBy(F.desc("df"), "term").limit(top)


def damerau(words: Column, term: str, edits: int) -> Column:
    """Whether a word is within ``edits`` edits, a swap of neighbours counting as one."""

    @F.pandas_udf("boolean")
    def near(column: pd.Series) -> pd.Series:
        return column.map(lambda w: w is not None and osa(w, term) <= edits)

    return near(words)


def osa(a: str, b: str) -> int:
    """Optimal string alignment distance."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
    return row[-1]


def highlight(hits: DataFrame, key: str, text: str, terms: list[str], size: int = 100, fragments: int = 2) -> DataFrame:
    """(key, fragment_no, fragment): stretches of about ``size`` characters with most hits, terms in <b>."""
    import regex

    find = regex.compile(r"(?<![\p{L}\p{N}])(?:" + "|".join(map(regex.escape, terms)) + r")(?![\p{L}\p{N}])", regex.IGNORECASE)
    kind = hits.schema[key].dataType.simpleString()

    def cut(text: str) -> list[str]:
        found: list[tuple[int, int, str]] = []
        begin = 0
        while begin < len(text):
            end = begin + size
            space = text.find(" ", end)
            end = len(text) if space < 0 or end >= len(text) else space
            piece = text[begin:end]
            n = len(find.findall(piece))
            if n:
                found.append((-n, begin, piece))
            begin = end + 1
        return [find.sub(lambda m: f"<b>{m.group()}</b>", p) for _, _, p in sorted(found)[:fragments]]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, p) for k, t in zip(f["k"], f["t"]) if t for i, p in enumerate(cut(t))]
            yield pd.DataFrame(rows, columns=[key, "fragment_no", "fragment"])

    return hits.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(work, f"{key} {kind}, fragment_no int, fragment string")
