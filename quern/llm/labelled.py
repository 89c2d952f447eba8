"""A bounded, documented sample of labelled rows, and small logistic fits on it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, per_class: int) -> DataFrame:
    """doc_id, text, y of at most per_class labelled documents of each class.

    Labels of rows whose crc32(doc_id as text) mod fold is 0 are never used (fold 0: all may be). Of several labels of a
    doc_id the largest counts; of several texts, each is a row. The rows with the lowest xxhash64(doc_id) are taken, so the
    sample is the same at every run; being bounded, it is broadcast to the documents.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if fold:
        rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % fold != 0)
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    key = F.xxhash64("doc_id")
    picked = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(key, "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (the last for a constant) of a small dense logistic regression, by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + l2 * np.r_[w[:-1], 0]
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(np.r_[np.full(len(w) - 1, l2), 1e-6])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_wide(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and constant of a wide dense logistic regression, by accelerated full-batch gradient steps; classes count alike."""
    scale = x.std(0)
    scale[scale < 1e-7] = np.inf
    z = ((x - x.mean(0)) / scale).astype(np.float32)
    mass = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())).astype(np.float32)
    v = np.ones(z.shape[1], np.float32)
    for _ in range(8):  # the largest curvature, by power steps
        v = z.T @ (mass * (z @ v))
        v /= max(float(np.linalg.norm(v)), 1e-12)
    rate = np.float32(1 / (0.25 * float(v @ (z.T @ (mass * (z @ v)))) + l2 + 0.25))
    w, past, b, past_b = np.zeros(z.shape[1], np.float32), np.zeros(z.shape[1], np.float32), 0.0, 0.0
    for k in range(rounds):
        m = np.float32(k / (k + 3))
        at, at_b = w + m * (w - past), b + float(m) * (b - past_b)
        r = mass * (1 / (1 + np.exp(-np.clip(z @ at + np.float32(at_b), -30, 30))) - y).astype(np.float32)
        past, past_b = w, b
        w, b = at - rate * (z.T @ r + np.float32(l2) * at), at_b - float(rate) * float(r.sum())
    w = w / scale
    return w.astype(np.float64), b - float(w @ x.mean(0))
