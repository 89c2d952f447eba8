"""Scoring against a static model, in batch or in Structured Streaming micro-batches (stream-static join, no state)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.classify import smoothed
from quern.operators.corpus import Corpus
from quern.operators.tokens import words_of


@dataclass
class NaiveBayesModel:
    """gains: word, class, gain (log ratio to an unseen word); classes: class, log_prior, log_unseen."""

    gains: DataFrame
    classes: DataFrame

    @classmethod
    def fit(cls, corpus: Corpus, method: str = "laplace") -> NaiveBayesModel:
        seen, unseen = smoothed(corpus, method)
        gains = seen.join(F.broadcast(unseen), "class").select("word", "class", F.log(F.col("p") / F.col("p0")).alias("gain"))
        classes = corpus.class_stats.select("class", F.log("prior").alias("log_prior")).join(unseen, "class").select("class", "log_prior", F.log("p0").alias("log_unseen"))
        return cls(gains, classes)

    def scores(self, docs: DataFrame) -> DataFrame:
        """doc_id, class, log_score of docs (doc_id, text), a batch (documents without known words: the priors)."""
        rows = docs.select("doc_id", F.explode(words_of(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
        rows = rows.join(self.gains.select("word").distinct(), "word", "left_semi")
        size = rows.groupBy("doc_id").agg(F.sum("n").alias("size"))
        delta = rows.join(self.gains, "word").groupBy("doc_id", "class").agg(F.sum(F.col("n") * F.col("gain")).alias("delta"))
        base = docs.select("doc_id").join(size, "doc_id", "left").crossJoin(F.broadcast(self.classes))  # a row a class
        score = F.col("log_prior") + F.coalesce("size", F.lit(0)) * F.col("log_unseen") + F.coalesce("delta", F.lit(0.0))
        return base.join(delta, ["doc_id", "class"], "left").select("doc_id", "class", score.alias("log_score"))

    def best(self, docs: DataFrame) -> DataFrame:
        """doc_id, class, log_score of the best class (ties: the first in order)."""
        s = self.scores(docs).select("doc_id", "class", F.round("log_score", 6).alias("log_score"))
        top = s.groupBy("doc_id").agg(F.min(F.struct((-F.col("log_score")).alias("cost"), "class")).alias("top"))
        return top.select("doc_id", F.col("top.class").alias("class"), (-F.col("top.cost")).alias("log_score"))

    def attach(self, stream: DataFrame, path: str, checkpoint: str):
        """Starts a query that scores each micro-batch of a stream (doc_id, text) and appends it to Parquet at path."""

        def each(batch: DataFrame, number: int) -> None:
            self.best(batch).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


@dataclass
class LineServer:
    """The commands of a line server over an index: ``,HITS n``, ``;INDEX``, ``;DELETE id``, ``;QUIT``, else a query."""

    docs: DataFrame
    hits: int = 10
    gone: tuple[int, ...] = ()

    def handle(self, line: str):
        """The rows of a query, or a state's name for a command (None: the connection ends)."""
        from quern.operators.retrieve import boolean_query, postings

        if line.startswith(",HITS "):
            self.hits = int(line.split()[1])
            return "hits"
        if line.startswith(";DELETE "):
            self.gone += (int(line.split()[1]),)
            return "deleted"
        if line.startswith(";INDEX "):
            number, text = line.split(" ", 2)[1:]
            add = self.docs.sparkSession.createDataFrame([(int(number), text)], "doc_id long, text string")
            self.docs = self.docs.select("doc_id", "text").where(F.col("doc_id") != int(number)).unionByName(add)
            self.gone = tuple(g for g in self.gone if g != int(number))
            return "indexed"
        if line.startswith(";QUIT"):
            return None
        live = self.docs.where(~F.col("doc_id").isin(*self.gone)) if self.gone else self.docs
        return boolean_query(postings(live), line, self.hits).collect()
