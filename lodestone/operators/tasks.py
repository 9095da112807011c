"""Task lines made from a collection's own terms, by bands of document frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def banded(dictionary: DataFrame, per_band: int) -> DataFrame:
    """(band, term, df): the ``per_band`` most frequent terms of the bands High, Med and Low.

    The bands' heads are cut by salt before they are ranked, so a band may hold any number of terms.
    """
    most = dictionary.agg(F.max("df")).first()[0] or 0
    band = F.when(F.col("df") >= most // 10, "High").when(F.col("df") >= most // 100, "Med").otherwise("Low")
    own = dictionary.withColumn("band", band)
    salted = Window.partitionBy("band", F.pmod(F.xxhash64("term"), F.lit(64))).orderBy(F.desc("df"), "term")
    own = own.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= per_band)
    whole = Window.partitionBy("band").orderBy(F.desc("df"), "term")
    return own.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= per_band).select("band", "term", "df", "r")


def generate(dictionary: DataFrame, per_band: int = 5) -> DataFrame:
    """(category, line) of term, prefix, wildcard, fuzzy, and, or and minShouldMatch tasks."""
    t = banded(dictionary, per_band)
    word = F.col("term")
    single = F.array(
        F.struct(F.concat(F.lit("Term"), "band").alias("category"), word.alias("text")),
        F.struct(F.lit("Prefix3").alias("category"), F.concat(F.substring(word, 1, 3), F.lit("*")).alias("text")),
        F.struct(F.lit("Wildcard").alias("category"), F.concat(F.substring(word, 1, 2), F.lit("*"), F.right(word, F.lit(1))).alias("text")),
        F.struct(F.lit("Fuzzy1").alias("category"), F.concat(word, F.lit("~1")).alias("text")),
        F.struct(F.lit("Fuzzy2").alias("category"), F.concat(word, F.lit("~2")).alias("text")),
    )
    ones = t.where(F.length("term") >= 4).select(F.explode(single).alias("x")).select("x.*")
    high = t.where("band = 'High'").select("r", word.alias("a"))
    low = t.where("band = 'Med'").select("r", word.alias("b"))
    pair = F.array(
        F.struct(F.lit("AndHighMed").alias("category"), F.concat(F.lit("+"), "a", F.lit(" +"), "b").alias("text")),
        F.struct(F.lit("OrHighMed").alias("category"), F.concat("a", F.lit(" "), "b").alias("text")),
        F.struct(F.lit("Msm").alias("category"), F.concat("a", F.lit(" "), "b", F.lit(" +minShouldMatch=2")).alias("text")),
        F.struct(F.lit("Near").alias("category"), F.concat(F.lit("near//"), "a", F.lit(" "), "b").alias("text")),
    )
    twos = high.join(low, "r").select(F.explode(pair).alias("x")).select("x.*")
    return ones.unionByName(twos).distinct().select("category", F.concat("category", F.lit(": "), "text").alias("line"))
