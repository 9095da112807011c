"""Language identification by frequent words and scripts, with a confusion table and a majority vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import tokens

# The most frequent small words of some languages, and the scripts that tell others.
SMALL_WORDS = {
    "en": "the of and to in is was for that with on as it by at from are this before after without".split(),
    "de": "der die das und in den von zu mit im ist auf nicht ein eine des dem für wurde am ohne nach bei".split(),
    "fr": "le la les de des du et en est un une que dans pour qui sur pas au a été sans après pendant".split(),
    "es": "el la los las de y en que un una es por con para del se no lo sin tras durante fue".split(),
}
SCRIPTS = {"ru": "Cyrillic", "el": "Greek", "hi": "Devanagari", "ar": "Arabic", "ko": "Hangul", "ja": "Hiragana", "th": "Thai", "zh": "Han"}


def scores(text: Column) -> Column:
    """array<struct<score, lang>> best first: letters of a script, or letters in small words of a language."""
    words = tokens(text)
    # kana outweighs the characters that Japanese shares with Chinese
    weight = {"ja": 3.0, "zh": 1.0}
    items = [F.struct((F.regexp_count(text, F.lit(rf"\p{{Is{s}}}")) * weight.get(lang, 1.0)).cast("double").alias("score"), F.lit(lang).alias("lang")) for lang, s in SCRIPTS.items()]
    for lang, small in SMALL_WORDS.items():
        listed = F.array(*[F.lit(w) for w in small])
        n = F.size(F.filter(words, _in(listed)))
        items.append(F.struct((n * 6.0).cast("double").alias("score"), F.lit(lang).alias("lang")))
    return F.sort_array(F.array(*items), asc=False)


def _in(listed: Column):
    return lambda w: F.array_contains(listed, w)


def detect(text: Column) -> Column:
    """The best language; null for a text that shows none."""
    best = F.get(scores(text), 0)
    return F.when(best["score"] > 0, best["lang"])


def confusion(docs: DataFrame, truth: str, text: str) -> DataFrame:
    """(truth, detected, count)."""
    return docs.select(F.col(truth).alias("truth"), detect(F.col(text)).alias("detected")).groupBy("truth", "detected").agg(F.count("*").alias("count"))


def majority(votes: DataFrame, key: str, label: str, fixed: str) -> DataFrame:
    """The most voted label of each key; a tie goes to ``fixed`` if it is among the first, else to the smallest."""
    counts = votes.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("votes"))
    w = Window.partitionBy(key).orderBy(F.desc("votes"), (F.col(label) != fixed).cast("int"), label)
    return counts.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, label, "votes")
