"""Vocabularies compared over a corpus: distinct words are counted first, each is encoded once, counts are joined back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token, rank of a file of lines ``base64 rank``; tokens that are no UTF-8 text by themselves are left out."""
    rows = spark.read.text(path).where("value <> ''").select(F.split("value", " ").alias("x"))
    rows = rows.select(F.unbase64(F.col("x")[0]).cast("string").alias("token"), F.col("x")[1].cast("long").alias("rank"))
    return rows.where(F.is_valid_utf8("token") & (F.length("token") > 0))


def write_vocabulary(tokens: DataFrame, path: str) -> None:
    """A file of ``token`` and ``rank`` in that form."""
    tokens.select(F.concat_ws(" ", F.base64(F.col("token").cast("binary")), F.col("rank").cast("string")).alias("value")).write.mode("overwrite").text(path)


def word_counts(docs: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """by, word, times: words are runs without white space."""
    words = docs.select(*by, F.explode(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("word"))
    return words.groupBy(*by, "word").agg(F.count("*").alias("times"))


def encoded_lengths(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, tokens: how many tokens the longest match from the left makes of each distinct word; a character that begins no token is one.

    Every place of a word meets the vocabulary's tokens that stand there in one join, the longest of each place is an aggregate, and
    one fold over a word's places counts those that a match begins at.
    """
    longest = vocabulary.agg(F.coalesce(F.max(F.length("token")), F.lit(1)).alias("_longest"))
    distinct = words.select("word").where("word <> ''").distinct().crossJoin(F.broadcast(longest))  # one row
    places = distinct.select("word", "_longest", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    room = F.least(F.col("_longest"), F.length("word") - F.col("at") + 1)
    tries = places.select("word", "at", F.explode(F.sequence(F.lit(1), room)).alias("size")).withColumn("token", F.expr("substring(word, at, size)"))
    met = tries.join(vocabulary.select("token").distinct(), "token").groupBy("word", "at").agg(F.max("size").alias("size"))
    steps = met.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("at", "size"))).alias("steps"))
    start = F.struct(F.lit(1).alias("next"), F.lit(0).alias("tokens"))
    here = lambda s, at: F.when(
        s["next"] == at, F.struct((at + F.coalesce(F.try_element_at(F.col("steps"), at), F.lit(1))).alias("next"), (s["tokens"] + 1).alias("tokens"))
    ).otherwise(s)
    all_words = words.select("word").where("word <> ''").distinct().join(steps, "word", "left")
    return all_words.select("word", F.aggregate(F.sequence(F.lit(1), F.length("word")), start, here, lambda s: s["tokens"]).cast("long").alias("tokens"))


def vocabulary_metrics(counts: DataFrame, by: Sequence[str], vocabularies: dict[str, DataFrame]) -> DataFrame:
    """by, vocabulary, words, tokens, chars, tokens_per_char, single_share (words that are one token), place (1: fewest tokens a character).

    ``counts``: by, word, times; ties are placed by the vocabulary's name.
    """
    from pyspark.sql import Window as W

    out = None
    for name, vocabulary in vocabularies.items():
        both = counts.join(encoded_lengths(counts, vocabulary), "word")
        one = both.groupBy(*by).agg(
            F.sum("times").alias("words"), F.sum(F.col("times") * F.col("tokens")).alias("tokens"), F.sum(F.col("times") * F.length("word")).alias("chars"),
            F.sum(F.when(F.col("tokens") == 1, F.col("times")).otherwise(0)).alias("_single"),
        ).withColumn("vocabulary", F.lit(name))
        out = one if out is None else out.unionByName(one)
    rates = out.withColumn("tokens_per_char", F.col("tokens") / F.col("chars")).withColumn("single_share", F.col("_single") / F.col("words")).drop("_single")
    return rates.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("tokens_per_char", "vocabulary")))
