"""Weighting, scaling and normalisation of the term matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.corpus import Corpus


def idf(tf: DataFrame, docs: DataFrame, form: str = "log", by: str = "docs") -> DataFrame:
    """word, idf over training documents: log2(N/df), sqrt(N/df) or N/df; df counts documents, or occurrences (by words)."""
    train = docs.where("tag = 'train'").select("doc_id")
    n = train.agg(F.count("*").alias("n_docs")) if by == "docs" else tf.join(train, "doc_id", "left_semi").agg(F.sum("n").alias("n_docs"))
    df = tf.join(train, "doc_id", "left_semi").groupBy("word").agg((F.count("*") if by == "docs" else F.sum("n")).alias("df"))
    ratio = F.col("n_docs") / F.col("df")
    return df.crossJoin(F.broadcast(n)).select("word", {"log": F.log2(ratio), "sqrt": F.sqrt(ratio), "straight": ratio}[form].alias("idf"))


def tfidf(tf: DataFrame, docs: DataFrame, form: str = "log", by: str = "docs", log_count: bool = True) -> DataFrame:
    """doc_id, word, n, weight = ln(n + 1) idf (or n idf) of all documents; words unknown to training have no cell."""
    count = F.log1p("n") if log_count else F.col("n")
    return tf.join(idf(tf, docs, form, by), "word").select("doc_id", "word", "n", (count * F.col("idf")).alias("weight"))


def normalise(weighted: DataFrame, how: str = "length", key: str = "doc_id") -> DataFrame:
    """Weights by vector length or sum; a vector of zeros has no rows."""
    w = Window.partitionBy(key)
    size = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(w)) if how == "length" else F.sum("weight").over(w)
    return weighted.withColumn("size", size).where("size != 0").withColumn("weight", F.col("weight") / F.col("size")).drop("size")


def query_weights(tf: DataFrame, words: DataFrame, how: str = "log_idf", length: float = 100.0) -> DataFrame:
    """Weights of query documents: count, idf (count idf), log_idf (ln(count + 1) idf), document (1), document_then_word."""
    if how == "count":
        return tf.withColumn("weight", F.col("n").cast("double"))
    if how == "document":
        return tf.withColumn("weight", F.lit(1.0))
    if how == "document_then_word":
        return tf.withColumn("weight", length * F.col("n") / F.sum("n").over(Window.partitionBy("doc_id")))
    count = F.col("n") if how == "idf" else F.log1p("n")
    return tf.join(words.select("word", "idf"), "word").withColumn("weight", count * F.col("idf")).drop("idf")


def scale(weighted: DataFrame, factor: DataFrame, column: str, on: tuple[str, ...] = ("word",)) -> DataFrame:
    """Weights times a factor of the word (information gain) or of class and word (foil gain)."""
    return weighted.join(factor.select(*on, F.col(column).alias("factor")), list(on)).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")


def smart(tf: DataFrame, docs: DataFrame, code: str = "ltc") -> DataFrame:
    """SMART triple: tf n (count), b (1), m (n / max), a (.5 + .5 n / max), l (1 + ln n); idf n or t (ln N/df); norm n or c (cosine).

    idf is over the training documents. Words unknown to them have no cell under t."""
    most = F.max("n").over(Window.partitionBy("doc_id"))
    part = {"n": F.col("n").cast("double"), "b": F.lit(1.0), "m": F.col("n") / most, "a": 0.5 + 0.5 * F.col("n") / most, "l": 1 + F.log("n")}[code[0]]
    rows = tf.withColumn("weight", part)
    if code[1] == "t":
        rows = scale(rows, idf(tf, docs, "straight").select("word", F.log("idf").alias("idf")), "idf")
    return normalise(rows) if code[2] == "c" else rows


def nb_weights(corpus: Corpus) -> DataFrame:
    """class, word, n, p (n over the class's words), pw (the word's share of all words)."""
    total = F.sum("n").over(Window.partitionBy())
    words = corpus.class_words.select("word", (F.col("total") / F.sum("total").over(Window.partitionBy())).alias("pw"))
    return corpus.class_tf.join(F.broadcast(corpus.class_stats.select("class", "word_count")), "class").join(words, "word").select("class", "word", "n", (F.col("n") / F.col("word_count")).alias("p"), "pw")


def prind_weights(corpus: Corpus) -> DataFrame:
    """class, word, weight = P(w|c) / P(w) with P(w) the mean over class-weighted counts."""
    return nb_weights(corpus).select("class", "word", (F.col("p") / F.col("pw")).alias("weight"))


def kl_weights(corpus: Corpus) -> DataFrame:
    """class, word, weight = P(w|c) ln(P(w|c) / P(w))."""
    return nb_weights(corpus).select("class", "word", (F.col("p") * F.log(F.col("p") / F.col("pw"))).alias("weight"))


def evi_weights(corpus: Corpus) -> DataFrame:
    """class, word, weight = (1 + n) / (V + Nc)."""
    v = corpus.class_words.agg(F.count("*").alias("v"))
    return corpus.class_tf.join(F.broadcast(corpus.class_stats.select("class", "word_count")), "class").crossJoin(F.broadcast(v)).select("class", "word", ((1 + F.col("n")) / (F.col("v") + F.col("word_count"))).alias("weight"))


def svm_weights(tf: DataFrame, docs: DataFrame, least_df: int = 3) -> DataFrame:
    """doc_id, word, weight: log2(n + 1) idf, idf 0 under least_df documents and scaled to mean 1 over words, summing to 1 in a document."""
    raw = idf(tf, docs).join(tf.join(docs.where("tag = 'train'").select("doc_id"), "doc_id", "left_semi").groupBy("word").agg(F.count("*").alias("df")), "word")
    cut = raw.select("word", F.when(F.col("df") < least_df, 0.0).otherwise(F.col("idf")).alias("idf"))
    mean = cut.agg(F.avg("idf").alias("mean"))
    scaled = cut.crossJoin(F.broadcast(mean)).select("word", (F.col("idf") / F.col("mean")).alias("idf"))
    return normalise(tf.join(scaled, "word").select("doc_id", "word", "n", (F.log2(F.col("n") + 1) * F.col("idf")).alias("weight")), "sum")
