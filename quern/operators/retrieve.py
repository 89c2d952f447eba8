"""Retrieval: ranked TF-IDF queries, and boolean, phrase and fielded queries over a positional index."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.lineage import stored
from quern.operators import weight as W
from quern.operators.blocks import Block, Blocks, batch
from quern.operators.tokens import STOPWORDS

INDEX_WORD = "[A-Za-z][A-Za-z0-9]*"


def postings(docs: DataFrame, text: str = "text", stop: tuple[str, ...] = (), key: str = "doc_id") -> DataFrame:
    """doc_id, pos, word: words begin with a letter, have 2 to 30 letters and digits; stop words take no position."""
    words = F.filter(F.transform(F.regexp_extract_all(F.col(text), F.lit(INDEX_WORD), 0), F.lower), lambda w: F.length(w).between(2, 30))
    return docs.select(key, F.posexplode(F.filter(words, lambda w: ~w.isin(*stop)) if stop else words).alias("pos", "word"))


def ranked_query(tf: DataFrame, docs: DataFrame, query: DataFrame, top: int = 10) -> DataFrame:
    """query_id, doc_id, score, words, rank: the `top` documents of each query (doc_id, word, n) by cosine of TF-IDF vectors.

    A block of documents answers all queries (a stated set) in one task, which yields its own best `top` of each. With a large `top` (over
    1000), every document that has a word of a query is a row."""
    idf = stored(W.idf(tf, docs), "idf")
    asked = W.normalise(query.join(idf, "word").withColumn("weight", F.log1p("n") * F.col("idf")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    if top <= 1000:
        return _best(tf, idf, asked, top).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    index = W.normalise(W.tfidf(tf, docs))
    hits = asked.select(F.col("doc_id").alias("query_id"), "word", F.col("weight").alias("q")).join(index.select("doc_id", "word", "weight"), "word")
    scores = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("q") * F.col("weight")), 9).alias("score"), F.array_join(F.array_sort(F.collect_list("word")), " ").alias("words"))
    return scores.withColumn("rank", F.row_number().over(best))


def _best(tf: DataFrame, idf: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """query_id, doc_id, score, words of the best `top` documents of each query in each block."""
    queries: dict[int, list[tuple[str, float]]] = {}
    for r in asked.select("doc_id", "word", "weight").collect():  # the queries
        queries.setdefault(r["doc_id"], []).append((r["word"], r["weight"]))
    schema = "query_id long, doc_id long, score double, words string"

    def work(block: Block, w: np.ndarray, known: dict) -> Iterator[pa.RecordBatch]:
        x = np.log1p(block.n) * np.nan_to_num(w[:, 0])[block.col]
        x = x / np.sqrt(np.maximum(np.bincount(block.row, x * x, len(block.docs)), 1e-300))[block.row]
        there = (~np.isnan(w[:, 0]))[block.col]  # a cell of a word that training knows
        by = np.argsort(block.col, kind="stable")
        begin = np.searchsorted(block.col[by], np.arange(len(block.words) + 1))
        norm = np.bincount(block.row, (x != 0) & there, len(block.docs)) > 0  # a vector of zeros has no rows
        out = []
        for query, cells in sorted(queries.items()):
            cells = sorted(cells)
            at = pc.index_in(pa.array([c for c, _ in cells]), block.words).to_pylist()
            spans = [(by[begin[k] : begin[k + 1]], c, q) for k, (c, q) in zip(at, cells) if k is not None]
            spans = [(s[there[s] & norm[block.row[s]]], c, q) for s, c, q in spans]
            if not any(len(s) for s, _, _ in spans):
                continue
            every = np.concatenate([s for s, _, _ in spans])
            score = np.round(np.bincount(block.row[every], np.concatenate([x[s] * q for s, _, q in spans]), len(block.docs)), 9)
            hits = np.unique(block.row[every])
            if len(hits) > top:
                hits = hits[score[hits] >= np.partition(score[hits], len(hits) - top)[len(hits) - top]]
            hits = hits[np.lexsort((block.docs[hits], -score[hits]))][:top]
            has: dict[int, list[str]] = {int(k): [] for k in hits}
            for s, c, _ in spans:
                for k in block.row[s[np.isin(block.row[s], hits)]].tolist():
                    has[k].append(c)
            out += [(query, int(block.docs[k]), float(score[k]), " ".join(has[int(k)])) for k in hits]
        if out:
            yield batch(schema, *map(list, zip(*out)))

    return Blocks.of(tf).run(work, schema, idf.select("word", F.array("idf").alias("w")), 1)


def compare(tf: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, cosine of raw counts of pairs of documents."""
    norm = tf.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    left = pairs.join(tf.select(F.col("doc_id").alias("a"), "word", "n"), "a")
    dots = left.join(tf.select(F.col("doc_id").alias("b"), "word", F.col("n").alias("m")), ["b", "word"]).groupBy("a", "b").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    return dots.join(norm.select(F.col("doc_id").alias("a"), F.col("norm").alias("x")), "a").join(norm.select(F.col("doc_id").alias("b"), F.col("norm").alias("y")), "b").select("a", "b", (F.col("dot") / (F.col("x") * F.col("y"))).alias("cosine"))


@dataclass(frozen=True)
class Term:
    """A term of a query: + required, - excluded, or '' optional; words (more than one: a phrase)."""

    flag: str
    words: tuple[str, ...]


def parse_query(text: str, stop: tuple[str, ...] = STOPWORDS) -> list[Term]:
    """``+term -term term "a phrase" field:term``; a field becomes termxxxfield; stop words are skipped."""
    out = []
    for flag, field, phrase, word in re.findall(r'([+-]?)(?:([A-Za-z]+):)?(?:"([^"]*)"|([^\s"]+))', text):
        words = [w.lower() for w in re.findall(INDEX_WORD, phrase or word)]
        words = [w + (f"xxx{field.lower()}" if field else "") for w in words if len(w) > 1 and w not in stop]
        if words:
            out.append(Term(flag, tuple(words)))
    return out


def term_hits(index: DataFrame, words: tuple[str, ...], compat_counts: bool = False) -> DataFrame:
    """doc_id, tf, score of a word or phrase: positions less the offset in the phrase agree. score = ln(5 + tf) / ln(5 + df)."""
    offset = F.create_map(*[F.lit(x) for k, w in enumerate(dict.fromkeys(words)) for x in (w, k)])
    places = [(w, k) for k, w in enumerate(words)]
    rows = index.where(F.col("word").isin(*words))
    if len(places) == 1:
        hits = rows.groupBy("doc_id").agg(F.count("*").alias("tf"))
    else:
        shifts = F.filter(F.array(*[F.when(F.col("word") == w, F.col("pos") - k) for w, k in places]), lambda x: x.isNotNull())
        starts = rows.select("doc_id", F.explode(shifts).alias("at"), "word").groupBy("doc_id", "at").agg(F.count("*").alias("n"))
        hits = starts.where(F.col("n") == len(places)).groupBy("doc_id").agg(F.count("*").alias("tf"))
    del offset
    if compat_counts:
        return hits.select("doc_id", "tf", F.col("tf").cast("double").alias("score"))
    df = hits.agg(F.count("*").alias("df"))
    return hits.crossJoin(F.broadcast(df)).select("doc_id", "tf", (F.log(5 + F.col("tf")) / F.log(5 + F.col("df"))).alias("score"))  # one row


def boolean_query(index: DataFrame, query: str, top: int = 10, deleted: DataFrame | None = None) -> DataFrame:
    """doc_id, score, rank. All + terms are required, - terms exclude, others add to the score (any of them, if there's no +)."""
    terms = parse_query(query)
    if deleted is not None:
        index = index.join(deleted.select("doc_id"), "doc_id", "left_anti")
    hits = {t: term_hits(index, t.words) for t in terms}
    need = [t for t in terms if t.flag == "+"]
    free = [t for t in terms if t.flag == ""]
    if not need and not free:
        return index.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    union = None
    for k, t in enumerate(need + free):
        part = hits[t].select("doc_id", "score", F.lit(int(t.flag == "+")).alias("needed"))
        union = part if union is None else union.unionByName(part)
    sums = union.groupBy("doc_id").agg(F.sum("score").alias("score"), F.sum("needed").alias("needed"))
    out = sums.where(F.col("needed") == len(need)).select("doc_id", F.round("score", 9).alias("score"))
    for t in terms:
        if t.flag == "-":
            out = out.join(hits[t].select("doc_id"), "doc_id", "left_anti")
    best = out.orderBy(F.desc("score"), "doc_id").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))  # top rows


def delete_documents(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs with the flag `deleted` set for the listed documents (adding a document again clears it)."""
    return docs.join(gone.select("doc_id", F.lit(True).alias("gone")), "doc_id", "left").withColumn("deleted", F.coalesce("gone", F.lit(False))).drop("gone")
