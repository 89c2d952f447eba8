"""Set operations on scored lists (key, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of either; scores add."""
    return a.unionByName(b).groupBy("key").agg(F.sum("score").alias("score"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of both; scores add."""
    return a.join(b.withColumnRenamed("score", "other"), "key").select("key", (F.col("score") + F.col("other")).alias("score"))


def overlay(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of a; scores of b add where it has the key."""
    return a.join(b.withColumnRenamed("score", "other"), "key", "left").select("key", (F.col("score") + F.coalesce("other", F.lit(0.0))).alias("score"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("key"), "key", "left_anti")


def append(a: DataFrame, key, score: float) -> DataFrame:
    """a with one more entry."""
    return a.unionByName(a.sparkSession.createDataFrame([(key, score)], a.schema))


def remove(a: DataFrame, key) -> DataFrame:
    return a.where(F.col("key") != key)


def lookup(a: DataFrame, key) -> DataFrame:
    return a.where(F.col("key") == key).select("score")


def top(a: DataFrame, n: int, ascending: bool = False) -> DataFrame:
    """The n highest (or lowest) scores; ties by key."""
    return a.orderBy(F.asc("score") if ascending else F.desc("score"), "key").limit(n)


def vector_sum(a: DataFrame, b: DataFrame) -> DataFrame:
    """word, n of two word vectors added."""
    return a.unionByName(b).groupBy("word").agg(F.sum("n").alias("n"))


def printed(tf: DataFrame, by: str = "doc_id", form: str = "({w}, {n})") -> DataFrame:
    """Each vector as one line, words in order."""
    pair = lambda x: F.format_string(form.replace("{w}", "%s").replace("{n}", "%d"), x["word"], x["n"])
    return tf.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "n"))), pair), " ").alias("line"))
