"""Vocabulary selection: pruning by counts, prefixes and lists, information gain, foil gain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.lineage import stored
from quern.functions.portable import uniform
from quern.operators.blocks import batch
from quern.operators.corpus import Corpus, vocabulary
from quern.operators.pairs import numbered, pair_rows


def keep_frequent(tf: DataFrame, least: int) -> DataFrame:
    """Words occurring at least `least` times (index time)."""
    return tf.join(vocabulary(tf).where(F.col("cf") >= least).select("word"), "word", "left_semi")


def hide_rare(tf: DataFrame, by: str = "df", most: int = 1) -> DataFrame:
    """Hides words whose df or cf is at most `most`."""
    return tf.join(vocabulary(tf).where(F.col(by) > most).select("word"), "word", "left_semi")


def hide_prefix(tf: DataFrame, prefix: str, without: bool = False) -> DataFrame:
    """Hides words with the prefix, or (without) those that lack it."""
    has = F.col("word").startswith(prefix)
    return tf.where(has if without else ~has)


def restrict(tf: DataFrame, words: DataFrame, exclude: bool = False) -> DataFrame:
    return tf.join(words.select("word"), "word", "left_anti" if exclude else "left_semi")


def _plogp(p):
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def information_gain(corpus: Corpus, event: str = "document") -> DataFrame:
    """word, ig = H(C) - P(w) H(C|w) - P(not w) H(C|not w) over training documents; mass is documents, or occurrences (event word).

    One pass over (class, word) cells: a class without the word adds only its whole mass, which is found by subtraction."""
    mass = "df" if event == "document" else "n"
    cells = corpus.class_tf.select("class", "word", F.col(mass).alias("m"))
    size = corpus.class_stats.select("class", F.col("n_docs" if event == "document" else "word_count").alias("size"))
    whole = size.agg(F.sum("size").alias("total"), F.sum(F.when(F.col("size") > 0, F.col("size") * F.log2("size")).otherwise(0.0)).alias("c"))
    xlog = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)
    per = cells.join(F.broadcast(size), "class").groupBy("word").agg(F.sum("m").alias("with"), F.sum(xlog(F.col("m"))).alias("in"), F.sum(xlog(F.col("size") - F.col("m")) - xlog(F.col("size"))).alias("out"))
    rows = per.crossJoin(F.broadcast(whole))  # one row
    n, a = F.col("total"), F.col("with")
    # n * H over a split is n log n - sum x log x.
    ig = ((xlog(n) - F.col("c")) - (xlog(a) - F.col("in")) - (xlog(n - a) - (F.col("c") + F.col("out")))) / n
    return rows.select("word", ig.alias("ig"))


def top_by_gain(tf: DataFrame, gain: DataFrame, n: int) -> DataFrame:
    """tf of the n words of highest gain (ties: the word)."""
    return restrict(tf, gain.orderBy(F.desc("ig"), "word").limit(n))


def pair_information_gain(corpus: Corpus, least_df: int = 7, above: float = 0.01) -> DataFrame:
    """w1 < w2, ig of the event that both words are in a training document, where above a bound; rare words are hidden first.

    Words in so few documents that no pair of theirs can pass the bound are left out before any pair is counted: the gain of an event in `a`
    documents is largest when all are of one class (it is convex in the classes' shares), and that grows with a up to the smallest class."""
    rows = corpus.train
    names = {r["class"]: r["size"] for r in corpus.class_stats.select("class", F.col("n_docs").alias("size")).collect()}  # a row a class
    classes = sorted(names)
    size = np.array([names[c] for c in classes], float)
    xlog = lambda x: np.where(x > 0, x * np.log2(np.maximum(x, 1e-300)), 0.0)
    n = size.sum()

    def gains(m: np.ndarray) -> np.ndarray:
        """ig of events with m documents of each class (first axis)."""
        side = size.reshape(-1, *[1] * (m.ndim - 1))
        a = m.sum(0)
        return ((xlog(n) - xlog(size).sum()) - (xlog(a) - xlog(m).sum(0)) - (xlog(n - a) - xlog(side - m).sum(0))) / n

    few = np.arange(1, int(size.min()) + 1) if len(size) else np.arange(0)
    best = np.array([gains(np.where(np.arange(len(size))[:, None] == k, few[None], 0).astype(float)) for k in range(len(size))]).max(0) if len(few) else few
    low = best <= above - 1e-9
    least = max(least_df, 1 + (int(low.argmin()) if not low.all() else len(few)))
    often = stored(numbered(rows.groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") >= least)), "often")
    place = F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(classes) for x in (c, k)]), F.col("class"))
    schema = "a long, b long, ig double"

    def work(counts: np.ndarray, lo: int) -> Iterator[pa.RecordBatch]:
        for i in range(counts.shape[1]):
            m = counts[:, i]
            j = np.flatnonzero(m.sum(0) > 0)
            j = j[j > lo + i]
            ig = gains(m[:, j])
            keep = ig > above
            yield batch(schema, np.full(keep.sum(), lo + i), j[keep], ig[keep])

    train = corpus.docs.where("tag = 'train'").select("doc_id", place.alias("mark"))
    out = stored(pair_rows(rows.select("doc_id", "word", "n"), often, work, schema, train, len(classes), True), "pairs")
    word = lambda at, name: often.select(F.col("at").alias(at), F.col("word").alias(name))
    return out.join(word("a", "w1"), "a").join(word("b", "w2"), "b").select("w1", "w2", "ig")


def foil_gain(corpus: Corpus, compat: bool = False) -> DataFrame:
    """class, word, gain over all documents: n_wc * (log2 P(c|w) - log2 P(c)); compat gives the inverted sign."""
    rows = corpus.tf.join(corpus.docs.select("doc_id", "class"), "doc_id").groupBy("class", "word").agg(F.count("*").alias("pos"))
    word = rows.groupBy("word").agg(F.sum("pos").alias("df"))
    size = corpus.docs.groupBy("class").agg(F.count("*").alias("size"))
    share = size.select("class", (F.col("size") / F.sum("size").over(Window.partitionBy())).alias("p"))
    gain = F.col("pos") * (F.log2(F.col("pos") / F.col("df")) - F.log2("p"))
    return rows.join(word, "word").join(F.broadcast(share), "class").select("class", "word", (-gain if compat else gain).alias("gain"))


def class_mutual_information(corpus: Corpus, top: int) -> DataFrame:
    """class, word, mi: of each class the `top` words by |n ln(n N / (Nc Nw))|."""
    cells = corpus.class_tf.select("class", "word", "n")
    by_class, by_word = Window.partitionBy("class"), Window.partitionBy("word")
    rows = cells.select("class", "word", "n", F.sum("n").over(by_class).alias("nc"), F.sum("n").over(by_word).alias("nw"))
    total = cells.agg(F.sum("n").alias("total"))
    mi = F.abs(F.col("n") * F.log(F.col("n") * F.col("total") / (F.col("nc") * F.col("nw"))))
    ranked = rows.crossJoin(F.broadcast(total)).select("class", "word", F.round(mi, 6).alias("mi"))
    return ranked.withColumn("k", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("mi"), "word"))).where(F.col("k") <= top).drop("k")


def keep_unlabelled(tf: DataFrame, docs: DataFrame, tag: str = "unlabeled") -> DataFrame:
    """tf of the words that documents of the tag have."""
    return restrict(tf, tf.join(docs.where(F.col("tag") == tag).select("doc_id"), "doc_id", "left_semi").select("word").distinct())


def noisy_counts(tf: DataFrame, seed: int = 1) -> DataFrame:
    """word, score: occurrences plus a seeded noise under 0.01 (a function of the word, so runs agree)."""
    return vocabulary(tf).select("word", (F.col("cf") + uniform("word", seed=seed) / 100).alias("score"))
