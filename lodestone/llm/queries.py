"""The queries of the llm problems: p1, p3, p7, p8, p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import encode, mixing, neardup, sentences, similar
from lodestone.operators import vectors
from lodestone.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return similar.similar_pairs(table(spark, sf, "line_docs").select("id", "vector"), k=5, least=0.9)


def p1_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 most similar of every id (a base 36 number) that is divisible by 100, among all."""
    asking = F.pmod(F.conv("id", 36, 10).cast("long"), F.lit(100)) == 0
    return similar.most_similar(table(spark, sf, "line_docs").select("id", "vector"), k=5, asking=asking)


def p1_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the lists, with the probes that p1_topk takes, against the exact search: the 10 most similar of every vec_id divisible by 100, among all."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    docs = e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    found = similar.most_similar(docs, k=10, asking=F.col("id").cast("long") % 100 == 0)
    found = found.select(F.col("id").cast("long").alias("query_id"), F.col("other").cast("long").alias("vec_id"))
    # the vector itself may be among the first 11
    near = vectors.knn(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 11, "cosine").where("query_id != vec_id")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return vectors.recall(found, near.withColumn("r", best).where("r <= 10"), "query_id", "vec_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "line_docs").select("id", "title", "text"), least=0.6, width=3, least_words=10)


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row a record: its class of equal words, the number of near texts and its group (five words, 0.8)."""
    return neardup.near_duplicate_groups(table(spark, sf, "line_docs").select("id", "title", "text"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode_column(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", encode.tokenizer_path("byte_bpe_50k.tiktoken"))


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, table(spark, sf, "mix_targets"), encode.tokenizer_path("byte_bpe_50k.tiktoken"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, sf))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentences(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_topk, p1_recall, p3_found, p3_groups, p7_ids, p8_mix, p8_shares, p9_found)}

#: None of these can be said in SQL on whole tables; they are tested against plain versions.
SQL: dict[str, str] = {}
