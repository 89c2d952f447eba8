"""Statistics of word distributions: Good-Turing discounts, Dirichlet fits, divergences."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.corpus import Corpus


def frequency_of_frequencies(corpus: Corpus, most: int = 8) -> DataFrame:
    """class, r, words: how many words a class has r times, r up to `most`."""
    return corpus.class_tf.where(F.col("n") <= most).groupBy("class", F.col("n").alias("r")).agg(F.count("*").alias("words"))


def simple_good_turing(freq: dict[int, int], k: int = 7) -> tuple[float, dict[int, float]]:
    """P0 and the discounted counts r* of r = 1..k: the Turing estimate until it meets the smoothed line, then the line."""
    rows = sorted(freq)
    total = sum(r * freq[r] for r in rows)
    if len(rows) < 2 or not total:
        return 0.0, {r: float(r) for r in range(1, k + 1)}
    p0 = freq.get(1, 0) / total
    z = []
    for j, r in enumerate(rows):
        q = rows[j - 1] if j else 0
        t = rows[j + 1] if j + 1 < len(rows) else 2 * r - q
        z.append(2 * freq[r] / (t - q))
    slope, intercept = np.polyfit(np.log(rows), np.log(z), 1)
    line = lambda r: math.exp(intercept + slope * math.log(r))
    out, smooth = {}, False
    for r in range(1, k + 1):
        y = (r + 1) * line(r + 1) / line(r)
        if not smooth and freq.get(r) and freq.get(r + 1):
            x = (r + 1) * freq[r + 1] / freq[r]
            sd = math.sqrt((r + 1) ** 2 * freq[r + 1] / freq[r] ** 2 * (1 + freq[r + 1] / freq[r]))
            if abs(x - y) <= 1.96 * sd:
                smooth = True
            else:
                out[r] = x
                continue
        smooth = True
        out[r] = y
    return p0, out


def good_turing(corpus: Corpus, k: int = 7) -> DataFrame:
    """class, r, discount (factor of a count r), p0 (share left for unseen words). The frequencies are a few rows a class."""
    rows = frequency_of_frequencies(corpus, 100).collect()
    out = []
    for name in sorted({r["class"] for r in rows}):
        p0, star = simple_good_turing({r["r"]: r["words"] for r in rows if r["class"] == name}, k)
        out += [(name, r, s / r, p0) for r, s in star.items()]
    return corpus.docs.sparkSession.createDataFrame(out, "class string, r int, discount double, p0 double")


def dirichlet_fit(counts: DataFrame) -> DataFrame:
    """word, alpha by matching moments of the shares over documents (doc_id, word, n); absent words count as 0.

    Sums over all documents need no zeros: mean = sum p / D, variance = sum p^2 / D - mean^2."""
    total = counts.groupBy("doc_id").agg(F.sum("n").alias("s"))
    d = total.agg(F.count("*").alias("d"))
    p = counts.join(total, "doc_id").select("word", (F.col("n") / F.col("s")).alias("p"))
    m = p.groupBy("word").agg(F.sum("p").alias("a"), F.sum(F.col("p") * F.col("p")).alias("b")).crossJoin(F.broadcast(d)).select("word", (F.col("a") / F.col("d")).alias("m"), (F.col("b") / F.col("d") - F.pow(F.col("a") / F.col("d"), 2)).alias("v"))
    last = m.agg(F.max("word").alias("last"))
    s = m.crossJoin(F.broadcast(last)).where((F.col("word") != F.col("last")) & (F.col("m") * (1 - F.col("m")) / F.col("v") > 1)).agg(F.exp(F.avg(F.log(F.col("m") * (1 - F.col("m")) / F.col("v") - 1))).alias("s"))
    return m.crossJoin(F.broadcast(s)).select("word", (F.col("s") * F.col("m")).alias("alpha"))


def log_evidence(counts: np.ndarray, alpha: np.ndarray) -> float:
    """ln of the Dirichlet-multinomial evidence of a bag of counts."""
    lg = np.vectorize(math.lgamma)
    return float(math.lgamma(alpha.sum()) - math.lgamma(alpha.sum() + counts.sum()) + (lg(alpha + counts) - lg(alpha)).sum())


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of positive numbers, by Stirling's series from x + 8 on."""
    up = F.lit(0.0)
    for k in range(8):
        up = up + F.log(x + k)
    y = x + 8
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - up


def bag_evidence(bags: DataFrame, alphas: DataFrame) -> DataFrame:
    """doc_id, class, log_evidence of bags (doc_id, word, n) under Dirichlets (class, word, alpha); words without an alpha are left out.

    A word that a bag lacks adds nothing, so only cells that are there are joined."""
    total = alphas.groupBy("class").agg(F.sum("alpha").alias("a"))
    rows = bags.join(alphas, "word").groupBy("doc_id", "class").agg(F.sum("n").alias("n"), F.sum(log_gamma(F.col("alpha") + F.col("n")) - log_gamma(F.col("alpha"))).alias("s"))
    return rows.join(F.broadcast(total), "class").select("doc_id", "class", (log_gamma(F.col("a")) - log_gamma(F.col("a") + F.col("n")) + F.col("s")).alias("log_evidence"))


def kl_words(a: DataFrame, b: DataFrame, words: DataFrame, add: float = 0.0) -> DataFrame:
    """kl, half_js and squared loss of two word distributions (word, n) over words, each count plus `add`."""
    n = lambda df, name: df.select("word", F.col("n").alias(name))
    rows = words.join(n(a, "x"), "word", "left").join(n(b, "y"), "word", "left").select((F.coalesce("x", F.lit(0)) + add).alias("x"), (F.coalesce("y", F.lit(0)) + add).alias("y"))
    sums = rows.agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    p, q = F.col("x") / F.col("sx"), F.col("y") / F.col("sy")
    both = rows.crossJoin(F.broadcast(sums)).where("x > 0")
    mid = (p + q) / 2
    return both.agg(F.sum(F.when(q > 0, p * F.log(p / q)).otherwise(float("inf"))).alias("kl"), F.sum(0.5 * p * F.log(p / mid)).alias("half_js"), F.sum(p * F.pow(p - q, 2)).alias("squared"))
