"""Closed-form classifiers. All score in the form "base and corrections": what a class gives to an unseen word is counted once
a document, and only seen (class, word) cells are joined, so documents are never crossed with the vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import weight as W
from quern.operators.blocks import Block, Blocks, batch, unpacked
from quern.operators.corpus import Corpus, merge_by_class, merge_weighted

def by_doc():
    return Window.partitionBy("doc_id")



def smoothed(corpus: Corpus, method: str = "laplace", m: float = 1.0, alphas: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(seen, unseen): class, word, p of words the class has; class, p0 of any other word (dirichlet: p0 times the word's alpha).

    laplace, m_estimate, witten_bell, dirichlet (alphas: word, alpha), document (of documents, for the Bernoulli model)."""
    v = corpus.class_words.agg(F.count("*").alias("v"))
    stats = corpus.class_stats.crossJoin(F.broadcast(v))  # one row
    cells = corpus.class_tf.join(F.broadcast(stats), "class")
    n, size, vocab, types = F.col("n"), F.col("word_count"), F.col("v"), F.col("n_unique")
    if method == "laplace":
        p, p0 = (n + 1) / (size + vocab), 1 / (size + vocab)
    elif method == "m_estimate":
        p, p0 = (n + m / vocab) / (size + m), (m / vocab) / (size + m)
    elif method == "witten_bell":
        p, p0 = n / (size + types), F.when(size == 0, 1 / vocab).when(vocab > types, types / ((size + types) * (vocab - types)))
    elif method == "document":
        p, p0 = (F.col("df") + 1) / (F.col("n_docs") + 2), 1 / (F.col("n_docs") + 2)
    elif method == "dirichlet":
        total = alphas.agg(F.sum("alpha").alias("sum_alpha"))
        cells, stats = cells.join(alphas, "word").crossJoin(F.broadcast(total)), stats.crossJoin(F.broadcast(total))
        p, p0 = (n + F.col("alpha")) / (size + F.col("sum_alpha")), 1 / (size + F.col("sum_alpha"))
    else:
        raise ValueError(method)
    return cells.select("class", "word", p.alias("p")), stats.select("class", p0.alias("p0"))


def softmax(scores: DataFrame) -> DataFrame:
    """doc_id, class, log_score to doc_id, class, score (sum 1 a document)."""
    e = F.exp(F.col("log_score") - F.max("log_score").over(by_doc()))
    return scores.withColumn("e", e).select("doc_id", "class", (F.col("e") / F.sum("e").over(by_doc())).alias("score"))


def ranked(scores: DataFrame, top: int | None = None) -> DataFrame:
    """Adds rank (1 best; ties: the class first in order)."""
    out = scores.withColumn("rank", F.row_number().over(by_doc().orderBy(F.desc("score"), "class")))
    return out.where(F.col("rank") <= top) if top else out


def _documents(corpus: Corpus, tag: str) -> DataFrame:
    return corpus.docs.where(F.col("tag") == tag).select("doc_id")


def _known(corpus: Corpus, tag: str) -> DataFrame:
    """tf of the tag's documents, without words the class matrix lacks."""
    return corpus.tf.join(_documents(corpus, tag), "doc_id", "left_semi").join(corpus.class_words.select("word"), "word", "left_semi")


def naive_bayes(corpus: Corpus, method: str = "laplace", tag: str = "test", binary: bool = False, uniform_priors: bool = False, event: str = "word", length: float = 100.0, temper: str = "none", **smooth) -> DataFrame:
    """doc_id, class, score by multinomial naive Bayes.

    event document_then_word: every document counts as `length` words. temper: anneal divides logs by (N + 1) / 7, entropy by
    N + 1. Documents without known words get the priors."""
    rows = _known(corpus, tag).withColumn("m", F.lit(1.0) if binary else F.col("n").cast("double"))
    if event == "document_then_word":
        rows = rows.withColumn("m", F.col("m") * length / F.sum("n").over(by_doc()))
    seen, unseen = smoothed(corpus, method, **smooth)
    size = rows.groupBy("doc_id").agg(F.sum("m").alias("size"))
    if method == "dirichlet":
        extra = rows.join(smooth["alphas"], "word").groupBy("doc_id").agg(F.sum(F.col("m") * F.log("alpha")).alias("alpha_log"))
        size = size.join(extra, "doc_id")
        base_p = F.col("p0") * F.col("alpha")
        gain = seen.join(F.broadcast(unseen), "class").join(smooth["alphas"], "word").select("class", "word", F.log(F.col("p") / base_p).alias("gain"))
    else:
        size = size.withColumn("alpha_log", F.lit(0.0))
        gain = seen.join(F.broadcast(unseen), "class").select("class", "word", F.log(F.col("p") / F.col("p0")).alias("gain"))
    delta = rows.join(gain, "word").groupBy("doc_id", "class").agg(F.sum(F.col("m") * F.col("gain")).alias("delta"))
    priors = corpus.class_stats.select("class", F.log(1 / F.count("*").over(Window.partitionBy()) if uniform_priors else F.col("prior")).alias("log_prior"))
    classes = F.broadcast(priors.join(unseen, "class"))  # a row a class
    base = _documents(corpus, tag).join(size, "doc_id", "left").crossJoin(classes)
    n = F.coalesce("size", F.lit(0.0))
    log_score = F.col("log_prior") + F.coalesce(n * F.log("p0"), F.lit(0.0)) + F.coalesce("alpha_log", F.lit(0.0)) + F.coalesce("delta", F.lit(0.0))
    divisor = {"none": F.lit(1.0), "anneal": (n + 1) / 7, "entropy": n + 1}[temper]
    return softmax(base.join(delta, ["doc_id", "class"], "left").select("doc_id", "class", (log_score / divisor).alias("log_score")))


def bernoulli(corpus: Corpus, tag: str = "test") -> DataFrame:
    """doc_id, class, score by the document event model over the whole vocabulary: sum of ln(1 - P) once a class, then
    corrections for the words that are there."""
    seen, unseen = smoothed(corpus, "document")
    v = corpus.class_words.agg(F.count("*").alias("v"))
    odds = seen.groupBy("class").agg(F.sum(F.log(1 - F.col("p"))).alias("absent"), F.count("*").alias("types"))
    classes = corpus.class_stats.select("class", F.log("prior").alias("log_prior")).join(unseen, "class").join(odds, "class").crossJoin(F.broadcast(v))
    classes = classes.select("class", "p0", (F.col("log_prior") + F.col("absent") + (F.col("v") - F.col("types")) * F.log(1 - F.col("p0"))).alias("base"))
    logit = lambda p: F.log(p / (1 - p))
    gain = seen.join(F.broadcast(unseen), "class").select("class", "word", (logit(F.col("p")) - logit(F.col("p0"))).alias("gain"))
    rows = _known(corpus, tag)
    size = rows.groupBy("doc_id").agg(F.count("*").alias("size"))
    delta = rows.join(gain, "word").groupBy("doc_id", "class").agg(F.sum("gain").alias("delta"))
    base = _documents(corpus, tag).join(size, "doc_id", "left").crossJoin(F.broadcast(classes))
    score = F.col("base") + F.coalesce(F.col("size") * logit(F.col("p0")), F.lit(0.0)) + F.coalesce("delta", F.lit(0.0))
    return softmax(base.join(delta, ["doc_id", "class"], "left").select("doc_id", "class", score.alias("log_score")))


def leave_one_out(corpus: Corpus) -> DataFrame:
    """doc_id, class, score of training documents by Laplace naive Bayes, each document's counts taken out of its own class
    (V and the priors stay)."""
    rows = corpus.train.select("doc_id", F.col("class").alias("own"), "word", "n")
    v = corpus.class_words.agg(F.count("*").alias("v"))
    size = rows.groupBy("doc_id", "own").agg(F.sum("n").alias("size"))
    cells = rows.join(corpus.class_tf.select("class", "word", F.col("n").alias("nwc")), "word")
    mine = F.when(F.col("class") == F.col("own"), F.col("n")).otherwise(0)
    delta = cells.groupBy("doc_id", "class").agg(F.sum(F.col("n") * F.log(F.col("nwc") - mine + 1)).alias("delta"))
    classes = F.broadcast(corpus.class_stats.crossJoin(F.broadcast(v)).select("class", "prior", "word_count", "v"))
    docs = corpus.docs.where("tag = 'train'").select("doc_id", F.col("class").alias("own")).join(size, ["doc_id", "own"], "left").crossJoin(classes)
    n = F.coalesce("size", F.lit(0))
    less = F.when(F.col("class") == F.col("own"), n).otherwise(0)
    score = F.log("prior") - n * F.log(F.col("word_count") - less + F.col("v")) + F.coalesce("delta", F.lit(0.0))
    return softmax(docs.join(delta, ["doc_id", "class"], "left").select("doc_id", "class", score.alias("log_score")))


def shrinkage(corpus: Corpus, tag: str = "test", root_share: float = 0.4) -> DataFrame:
    """doc_id, class, score with P(w|c) a mixture of uniform (singletons / N), root and class."""
    singles = corpus.class_tf.groupBy("class").agg(F.sum((F.col("n") == 1).cast("int")).alias("singles"))
    v = corpus.class_words.agg(F.count("*").alias("v"), F.sum("total").alias("all"))
    classes = corpus.class_stats.join(singles, "class").crossJoin(F.broadcast(v)).select("class", F.log("prior").alias("log_prior"), "word_count", "v", (F.col("singles") / F.col("word_count")).alias("lu"), "all")
    rows = _known(corpus, tag).join(corpus.class_words, "word").crossJoin(F.broadcast(classes))
    rows = rows.join(corpus.class_tf.select("class", "word", F.col("n").alias("nwc")), ["class", "word"], "left")
    rest = 1 - F.col("lu")
    p = F.col("lu") / F.col("v") + root_share * rest * F.col("total") / F.col("all") + (1 - root_share) * rest * F.coalesce("nwc", F.lit(0)) / F.col("word_count")
    sums = rows.groupBy("doc_id", "class").agg(F.sum(F.col("n") * F.log(p)).alias("s"))
    base = _documents(corpus, tag).crossJoin(F.broadcast(classes.select("class", "log_prior")))
    return softmax(base.join(sums, ["doc_id", "class"], "left").select("doc_id", "class", (F.col("log_prior") + F.coalesce("s", F.lit(0.0))).alias("log_score")))


def rocchio(corpus: Corpus, tag: str = "test", form: str = "log", by: str = "docs", log_count: bool = True) -> DataFrame:
    """doc_id, class, score, hits: cosine of TF-IDF vectors of documents and of merged classes; only classes with a common word."""
    weighted = W.tfidf(corpus.tf, corpus.docs, form, by, log_count)
    classes = W.normalise(merge_weighted(weighted, corpus.docs), key="class")
    queries = W.normalise(weighted.join(_documents(corpus, tag), "doc_id", "left_semi"))
    return queries.select("doc_id", "word", F.col("weight").alias("q")).join(classes, "word").groupBy("doc_id", "class").agg(F.sum(F.col("q") * F.col("weight")).alias("score"), F.count("*").alias("hits"))


def prind(corpus: Corpus, tag: str = "test") -> DataFrame:
    """doc_id, class, score: sum of P(w|d) P(c) P(w|c) / P(w), scaled to sum 1; documents without known words: uniform."""
    rows = _known(corpus, tag).withColumn("q", F.col("n") / F.sum("n").over(by_doc()))
    priors = F.broadcast(corpus.class_stats.select("class", "prior"))
    sums = rows.join(W.prind_weights(corpus), "word").groupBy("doc_id", "class").agg(F.sum(F.col("q") * F.col("weight")).alias("s"))
    all_ = _documents(corpus, tag).crossJoin(priors).join(sums, ["doc_id", "class"], "left").withColumn("s", F.coalesce(F.col("s") * F.col("prior"), F.lit(0.0)))
    total = F.sum("s").over(by_doc())
    return all_.select("doc_id", "class", F.when(total > 0, F.col("s") / total).otherwise(1 / F.count("*").over(by_doc())).alias("score"))


def kl_divergence(corpus: Corpus, tag: str = "test") -> DataFrame:
    """doc_id, class, score: ln prior / N + sum of P(w|d) ln(P(w|c) / P(w|d)), scaled to sum -1; Laplace P(w|c)."""
    seen, unseen = smoothed(corpus)
    rows = _known(corpus, tag).withColumn("q", F.col("n") / F.sum("n").over(by_doc()))
    gain = seen.join(F.broadcast(unseen), "class").select("class", "word", F.log(F.col("p") / F.col("p0")).alias("gain"))
    delta = rows.join(gain, "word").groupBy("doc_id", "class").agg(F.sum(F.col("q") * F.col("gain")).alias("delta"))
    own = rows.groupBy("doc_id").agg(F.sum("n").alias("size"), F.sum(F.col("q") * F.log("q")).alias("neg_entropy"))
    classes = F.broadcast(corpus.class_stats.select("class", F.log("prior").alias("log_prior")).join(unseen, "class"))
    raw = own.crossJoin(classes).join(delta, ["doc_id", "class"], "left")
    raw = raw.select("doc_id", "class", (F.col("log_prior") / F.col("size") + F.log("p0") + F.coalesce("delta", F.lit(0.0)) - F.col("neg_entropy")).alias("s"))
    return raw.select("doc_id", "class", (F.col("s") / F.abs(F.sum("s").over(by_doc()))).alias("score"))


def evidence(corpus: Corpus, tag: str = "test") -> DataFrame:
    """doc_id, class, score: log-odds of the class's share of words, plus for each distinct word the change of log-odds by
    P(c|w) = (n + 1) / (n_w + K)."""
    k = corpus.class_stats.agg(F.count("*").alias("k"))
    share = corpus.class_stats.select("class", (F.col("word_count") / F.sum("word_count").over(Window.partitionBy())).alias("share"))
    prior = F.broadcast(share.select("class", F.log(F.col("share") / (1 - F.col("share"))).alias("prior")))
    words = corpus.class_words.crossJoin(F.broadcast(k)).select("word", "total", "k", (-F.log(F.col("total") + F.col("k") - 1)).alias("none"))
    rows = _known(corpus, tag).join(words, "word")
    base = rows.groupBy("doc_id").agg(F.sum("none").alias("none"), F.count("*").alias("size"))
    cells = corpus.class_tf.select("class", "word", F.col("n").alias("nwc"))
    odds = F.log((F.col("nwc") + 1) / (F.col("total") + F.col("k") - F.col("nwc") - 1))
    delta = rows.join(cells, "word").groupBy("doc_id", "class").agg(F.sum(odds - F.col("none")).alias("delta"))
    all_ = _documents(corpus, tag).crossJoin(prior).join(base, "doc_id", "left").join(delta, ["doc_id", "class"], "left")
    score = F.col("prior") * (1 - F.coalesce("size", F.lit(0))) + F.coalesce("none", F.lit(0.0)) + F.coalesce("delta", F.lit(0.0))
    return all_.select("doc_id", "class", score.alias("score"))


def nearest(corpus: Corpus, k: int = 30, code: str = "ltc", query: str = "ltc", tag: str = "test") -> DataFrame:
    """doc_id, class, score: sums of the similarities of the k most similar training documents, by class.

    All pairs are compared, a block of documents with a block of training documents at a time; only the k best of a block leave a task."""
    train = W.smart(corpus.tf.join(_documents(corpus, "train"), "doc_id", "left_semi"), corpus.docs, code)
    asked = W.smart(corpus.tf, corpus.docs, query).join(_documents(corpus, tag), "doc_id", "left_semi")
    left, right = (Blocks.of(x.select("doc_id", "word", F.col("weight").alias("n")), most=600_000).rows for x in (asked, train))
    pairs = left.select(*[F.col(c).alias(f"left_{c}") for c in ("data", "size", "words")]).crossJoin(right.select("data", "size", "words").hint("shuffle_replicate_nl"))  # a row two blocks; nothing is shuffled
    sims = pairs.mapInArrow(_most_similar(k), "doc_id long, other long, sim double")
    best = sims.withColumn("k", F.row_number().over(by_doc().orderBy(F.desc("sim"), "other"))).where(F.col("k") <= k)
    return best.join(corpus.docs.select(F.col("doc_id").alias("other"), "class"), "other").groupBy("doc_id", "class").agg(F.sum("sim").alias("score"))


def _most_similar(k: int, cells: int = 10_000_000) -> Callable:
    """Of pairs of blocks, the k most similar documents of the right block to each of the left: doc_id, other, sim.

    Words that many documents of both have are multiplied as dense matrices, the others cell by cell; `cells` similarities are there at a time."""

    def part(a: Block, b: Block) -> Iterator[pa.RecordBatch]:
        to = pc.index_in(a.words, b.words).fill_null(-1).to_numpy(zero_copy_only=False)
        col = to[a.col]
        keep = col >= 0
        row, col, x = a.row[keep], col[keep], a.n[keep]
        df_a, df_b = np.bincount(col, minlength=len(b.words)), np.bincount(b.col, minlength=len(b.words))
        many = df_a * df_b > len(a.docs) * len(b.docs) / 200
        place = np.cumsum(many) - 1
        by = np.argsort(b.col, kind="stable")
        begin = np.concatenate([[0], np.cumsum(df_b)])
        other, y = b.row[by], b.n[by]
        dense = np.zeros((many.sum(), len(b.docs)))
        own = many[b.col]
        dense[place[b.col[own]], b.row[own]] = b.n[own]
        step = max(1, min(cells // max(1, len(b.docs)), len(a.docs)))
        for lo in range(0, len(a.docs), step):
            at = slice(*np.searchsorted(row, [lo, lo + step]))
            n = min(step, len(a.docs) - lo)
            r, c, v = row[at] - lo, col[at], x[at]
            hot = many[c]
            q = np.zeros((n, len(dense)))
            q[r[hot], place[c[hot]]] = v[hot]
            sim = q @ dense
            r, c, v = r[~hot], c[~hot], v[~hot]
            sizes = df_b[c]
            ends = np.cumsum(sizes)
            flat, start = sim.ravel(), 0
            while start < len(c):  # as many products at a time as there are similarities, about
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + cells)))
                s = sizes[start:stop]
                j = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + np.repeat(begin[c[start:stop]], s)
                flat += np.bincount(np.repeat(r[start:stop], s).astype(np.int64) * len(b.docs) + other[j], np.repeat(v[start:stop], s) * y[j], len(flat))
                start = stop
            sim = np.round(sim, 9)
            if len(b.docs) > k:
                least = np.partition(sim, len(b.docs) - k, 1)[:, [len(b.docs) - k]]
                i, j = np.nonzero((sim >= least) & (sim > 0))
            else:
                i, j = np.nonzero(sim > 0)
            order = np.lexsort((j, -sim[i, j], i))
            i, j = i[order], j[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[rank < k], j[rank < k]
            yield batch("doc_id long, other long, sim double", a.docs[lo + i], b.docs[j], sim[i, j])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            for r in range(rows.num_rows):
                one = rows.slice(r, 1)
                yield from part(unpacked(one["left_data"], one["left_size"], one["left_words"]), unpacked(one["data"], one["size"], one["words"]))

    return run


#: Methods by name: corpus to doc_id, class, score.
METHODS: dict[str, Callable[..., DataFrame]] = {
    "naivebayes": naive_bayes,
    "nbsimple": lambda c, **k: naive_bayes(c, "laplace", **k),
    "nbshrinkage": shrinkage,
    "tfidf": rocchio,
    "tfidf_log_occur": rocchio,
    "tfidf_words": lambda c, **k: rocchio(c, by="words", log_count=False, **k),
    "tfidf_log_words": lambda c, **k: rocchio(c, by="words", **k),
    "prind": prind,
    "kl": kl_divergence,
    "evi": evidence,
    "knn": nearest,
    "crossentropy": lambda c, **k: naive_bayes(c, temper="entropy", **k),
    "bernoulli": bernoulli,
}


def register(name: str, method: Callable[..., DataFrame]) -> None:
    METHODS[name] = method


def merged(corpus: Corpus, event: str) -> DataFrame:
    return merge_by_class(corpus.tf, corpus.docs, event)
