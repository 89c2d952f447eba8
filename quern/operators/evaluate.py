"""Evaluation of predictions and diagnostics of class models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.classify import ranked, smoothed
from quern.operators.corpus import Corpus


def predictions(scores: DataFrame, docs: DataFrame, trial: int = 0) -> DataFrame:
    """trial, doc_id, actual, predicted, score of the best class."""
    best = ranked(scores, 1).select("doc_id", F.col("class").alias("predicted"), "score")
    return best.join(docs.select("doc_id", F.col("class").alias("actual")), "doc_id").select(F.lit(trial).alias("trial"), "doc_id", "actual", "predicted", "score")


def accuracy(preds: DataFrame) -> DataFrame:
    return preds.groupBy("trial").agg(F.count("*").alias("n"), (100 * F.avg((F.col("actual") == F.col("predicted")).cast("int"))).alias("accuracy"))


def accuracy_summary(preds: DataFrame) -> DataFrame:
    """Mean accuracy over trials and its standard error (population deviation over the root of their number)."""
    return accuracy(preds).agg(F.count("*").alias("trials"), F.avg("accuracy").alias("mean"), (F.stddev_pop("accuracy") / F.sqrt(F.count("*"))).alias("stderr"))


def confusion(preds: DataFrame) -> DataFrame:
    return preds.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def precision_recall(scores: DataFrame, docs: DataFrame, positive: str) -> DataFrame:
    """score, precision, recall of a class at every distinct score (ties come in together)."""
    rows = scores.where(F.col("class") == positive).join(docs.select("doc_id", F.col("class").alias("actual")), "doc_id").select(F.round("score", 9).alias("score"), (F.col("actual") == positive).cast("int").alias("hit"))
    steps = rows.groupBy("score").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    total = steps.agg(F.sum("hits").alias("positives"))
    run = steps.select("score", F.sum("hits").over(down).alias("tp"), F.sum("n").over(down).alias("seen")).crossJoin(F.broadcast(total))
    return run.select("score", "tp", "seen", (F.col("tp") / F.col("seen")).alias("precision"), (F.col("tp") / F.col("positives")).alias("recall"))


def break_even(curve: DataFrame) -> DataFrame:
    """The largest of the smaller of precision and recall."""
    return curve.agg(F.max(F.least("precision", "recall")).alias("break_even"))


def accuracy_coverage(preds: DataFrame) -> DataFrame:
    """score, coverage, accuracy of the documents scored at least so high."""
    steps = preds.select(F.round("score", 9).alias("score"), (F.col("actual") == F.col("predicted")).cast("int").alias("hit")).groupBy("score").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    total = steps.agg(F.sum("n").alias("all"))
    run = steps.select("score", F.sum("hits").over(down).alias("tp"), F.sum("n").over(down).alias("seen")).crossJoin(F.broadcast(total))
    return run.select("score", (F.col("seen") / F.col("all")).alias("coverage"), (F.col("tp") / F.col("seen")).alias("accuracy"))


def rank_histogram(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """rank, n, share up to it, inverse (n / rank over all): where the right class came."""
    hits = ranked(scores).join(docs.select("doc_id", "class"), ["doc_id", "class"]).groupBy("rank").agg(F.count("*").alias("n"))
    all_ = Window.partitionBy()
    return hits.select("rank", "n", (F.sum("n").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(all_)).alias("share"), (F.col("n") / F.col("rank") / F.sum("n").over(all_)).alias("inverse"))


def log_odds(corpus: Corpus, top: int = 10) -> DataFrame:
    """class, word, lor = P(w|c) ln(P(w|c) / P(w|not c)), Laplace on both; positive values, the `top` of each class."""
    total = corpus.class_words.agg(F.sum("total").alias("all"), F.count("*").alias("v"))
    rows = corpus.class_tf.select("class", "word", "n").join(corpus.class_words, "word").join(F.broadcast(corpus.class_stats.select("class", "word_count")), "class").crossJoin(F.broadcast(total))
    p = (F.col("n") + 1) / (F.col("word_count") + F.col("v"))
    q = (F.col("total") - F.col("n") + 1) / (F.col("all") - F.col("word_count") + F.col("v"))
    lor = rows.select("class", "word", F.round(p * F.log(p / q), 9).alias("lor")).where("lor > 0")
    return lor.withColumn("k", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("lor"), "word"))).where(F.col("k") <= top).drop("k")


def odds_ratio(corpus: Corpus, top: int = 10) -> DataFrame:
    """class, word, odds = P(w|c) / sum of P(w|other classes), Laplace; the `top` of each class."""
    seen, unseen = smoothed(corpus)
    totals = seen.join(F.broadcast(unseen), "class").groupBy("word").agg(F.sum(F.col("p") - F.col("p0")).alias("extra"))
    base = unseen.agg(F.sum("p0").alias("base"))
    rows = seen.join(totals, "word").crossJoin(F.broadcast(base))
    odds = rows.select("class", "word", F.round(F.col("p") / (F.col("base") + F.col("extra") - F.col("p")), 6).alias("odds"))
    return odds.withColumn("k", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("odds"), "word"))).where(F.col("k") <= top).drop("k")


def class_word_counts(corpus: Corpus, word: str) -> DataFrame:
    """class, n, word_count, share of a word in every class."""
    cell = corpus.class_tf.where(F.col("word") == word).select("class", "n")
    rows = corpus.class_stats.join(cell, "class", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("class", n.alias("n"), "word_count", (n / F.nullif(F.col("word_count"), F.lit(0))).alias("share"))
