"""Counting, the dictionary, and merging by class: everything is one sparse relation and aggregates over it.

tf(doc_id, word, n) joined to docs(doc_id, class, tag). Class tables are small next to tf; Spark is left to broadcast them
where their size allows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.lineage import stored
from quern.operators.tokens import tokens, words_of


def term_counts(toks: DataFrame, *keys: str) -> DataFrame:
    return toks.groupBy(*(keys or ("doc_id",)), "word").agg(F.count("*").alias("n"))


def dictionary(toks: DataFrame) -> DataFrame:
    """word, wi: words numbered in order of first appearance (document, then position).

    The rank is global, so it's found in two steps: by range partitions of the first appearance, then offsets by partition. The ranges
    are stored: they follow a sample, which a second reading would draw anew, and then ranks and offsets wouldn't agree."""
    first = toks.groupBy("word").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    ranged = stored(first.repartitionByRange(F.col("first")).withColumn("part", F.spark_partition_id()), "ranges")
    local = ranged.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("first")))
    sizes = local.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # a row a partition
    return local.join(F.broadcast(before.select("part", F.coalesce("before", F.lit(0)).alias("before"))), "part").select("word", (F.col("before") + F.col("k") - 1).cast("int").alias("wi"))


def vocabulary(tf: DataFrame) -> DataFrame:
    """word, df (documents), cf (occurrences)."""
    return tf.groupBy("word").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


@dataclass
class Corpus:
    """docs (doc_id, class, tag, ...) and tf (doc_id, word, n), with what follows from them."""

    docs: DataFrame
    tf: DataFrame
    keep: bool = False  # class_tf is stored too

    @classmethod
    def of(cls, docs: DataFrame, label: Column, tag: Column | None = None, words: Column | None = None, keep: bool = False) -> Corpus:
        """keep: the documents' tags and tf are computed at once and stored, for plans that read them more than once."""
        tag = tag if tag is not None else F.when(F.col("doc_id") % 10 < 7, "train").otherwise("test")
        meta = docs.select("doc_id", label.alias("class"), tag.alias("tag"))
        tf = term_counts(tokens(docs, words=words if words is not None else words_of(F.col("text"))))
        return cls(stored(meta, "docs"), stored(tf, "tf"), True) if keep else cls(meta, tf)

    def tagged(self, tag: str) -> DataFrame:
        """tf of the documents of a tag, with their class."""
        return self.tf.join(self.docs.where(F.col("tag") == tag).select("doc_id", "class"), "doc_id")

    @cached_property
    def train(self) -> DataFrame:
        return self.tagged("train")

    @cached_property
    def class_tf(self) -> DataFrame:
        """class, word, n (occurrences), df (documents) over the training documents."""
        rows = self.train.groupBy("class", "word").agg(F.sum("n").alias("n"), F.count("*").alias("df"))
        return stored(rows, "class_tf") if self.keep else rows

    @cached_property
    def class_stats(self) -> DataFrame:
        """class, n_docs, prior, word_count, n_unique over the training documents."""
        docs = self.docs.where("tag = 'train'").groupBy("class").agg(F.count("*").alias("n_docs"))
        words = self.class_tf.groupBy("class").agg(F.sum("n").alias("word_count"), F.count("*").alias("n_unique"))
        total = F.sum("n_docs").over(Window.partitionBy())
        return docs.join(words, "class", "left").select("class", "n_docs", (F.col("n_docs") / total).alias("prior"), F.coalesce("word_count", F.lit(0)).alias("word_count"), F.coalesce("n_unique", F.lit(0)).alias("n_unique"))

    @cached_property
    def class_words(self) -> DataFrame:
        """word, total: the words of the class matrix, of which there are V."""
        return self.class_tf.groupBy("word").agg(F.sum("n").alias("total"))


def merge_by_class(tf: DataFrame, docs: DataFrame, event: str = "word", length: float = 100.0) -> DataFrame:
    """class, word, weight over documents tagged train. event: word (occurrences), document (documents), or document_then_word
    (every document counts as `length` words)."""
    rows = tf.join(docs.where("tag = 'train'").select("doc_id", "class"), "doc_id")
    if event == "document":
        weight = F.count("*").cast("double")
    elif event == "document_then_word":
        total = tf.groupBy("doc_id").agg(F.sum("n").alias("size"))
        rows, weight = rows.join(total, "doc_id"), F.sum(length * F.col("n") / F.col("size"))
    else:
        weight = F.sum("n").cast("double")
    return rows.groupBy("class", "word").agg(weight.alias("weight"))


def merge_weighted(weighted: DataFrame, docs: DataFrame) -> DataFrame:
    """class, word, weight by summing weights; a cell of weight 0 counts with its occurrences (so words of every document stay)."""
    rows = weighted.join(docs.where("tag = 'train'").select("doc_id", "class"), "doc_id")
    return rows.groupBy("class", "word").agg(F.sum(F.when(F.col("weight") == 0, F.col("n")).otherwise(F.col("weight"))).alias("weight"))


def soft_merge(tf: DataFrame, probs: DataFrame) -> DataFrame:
    """class, word, weight with documents shared among classes by probs (doc_id, class, p)."""
    return tf.join(probs, "doc_id").groupBy("class", "word").agg(F.sum(F.col("n") * F.col("p")).alias("weight"))


def soft_priors(probs: DataFrame) -> DataFrame:
    """class, prior = (1 + sum p) / (K + D)."""
    sums = probs.groupBy("class").agg(F.sum("p").alias("s"))
    whole = Window.partitionBy()
    return sums.select("class", ((1 + F.col("s")) / (F.count("*").over(whole) + F.sum("s").over(whole))).alias("prior"))


def uniform_document_priors(docs: DataFrame) -> DataFrame:
    """doc_id, class, prior: a training document's share of its class, so that classes weigh alike."""
    n = docs.where("tag = 'train'").groupBy("class").agg(F.count("*").alias("n"))
    return docs.where("tag = 'train'").join(n, "class").select("doc_id", "class", (1 / F.col("n")).alias("prior"))


def matrix_stats(tf: DataFrame) -> DataFrame:
    """Number of words, and the shortest, mean and longest column (documents of a word)."""
    return vocabulary(tf).agg(F.count("*").alias("words"), F.min("df").alias("shortest"), F.avg("df").alias("mean"), F.max("df").alias("longest"))


def same_matrix(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: cells only in a, cells only in b."""
    cols = ["doc_id", "word", "n"]
    count = lambda x, y, name: x.select(cols).exceptAll(y.select(cols)).agg(F.count("*").alias(name))
    return count(a, b, "only_a").crossJoin(count(b, a, "only_b"))  # one row each


def cooccurrence(tf: DataFrame, least_df: int = 7) -> DataFrame:
    """w1, w2, n: for every ordered pair of words in a document (a word with itself too) the product of their counts, summed.

    Words in fewer than least_df documents are hidden first. A document's pairs are made where its words are: its words are
    few next to the pairs, so they come as one array, which is exploded twice."""
    often = tf.groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") >= least_df).select("word")
    bags = tf.join(often, "word").groupBy("doc_id").agg(F.collect_list(F.struct("word", "n")).alias("bag"))
    left = bags.select(F.explode("bag").alias("x"), "bag").select("x", F.explode("bag").alias("y"))
    return left.groupBy(F.col("x.word").alias("w1"), F.col("y.word").alias("w2")).agg(F.sum(F.col("x.n") * F.col("y.n")).alias("n"))


def cooccurrence_entropy(pairs: DataFrame) -> DataFrame:
    """word, entropy of P(w2 | w1), an m-estimate with m = V div 100 over the V words."""
    v = pairs.select("w1").distinct().agg(F.count("*").alias("v"))
    sums = pairs.groupBy("w1").agg(F.sum("n").alias("s"), F.count("*").alias("seen"))
    rows = pairs.join(sums, "w1").crossJoin(F.broadcast(v))  # one row
    m = F.floor(F.col("v") / 100)
    p = (F.col("n") + m / F.col("v")) / (F.col("s") + m)
    per = rows.groupBy(F.col("w1").alias("word")).agg((-F.sum(p * F.log2(p))).alias("h"), F.max("v").alias("v"), F.max("s").alias("s"), F.max("seen").alias("seen"))
    rest = (m / F.col("v")) / (F.col("s") + m)
    return per.select("word", (F.col("h") + F.when(rest > 0, -(F.col("v") - F.col("seen")) * rest * F.log2(rest)).otherwise(0.0)).alias("entropy"))
