"""Quality rules: base counts, and a calibrated logistic regression over hashed word and character n-grams.

The model is a mean of hashed weights over a text's words, adjacent word pairs and
bytes 3-grams, so scoring is a gather and a prefix sum over an Arrow batch. It is
fitted on a bounded sample of labelled rows (`per_class`), calibrated by a logistic
map on rows held out of it, and compared with a fixed threshold.

Defined results: null text has no words; every row gives a row; without labelled
rows of both classes the model keeps all that the base rules keep.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm import vec
from quern.llm.common import chunks, id_text
from quern.llm.labelled import fit_logistic, fit_wide, labelled_sample

BITS = 12
SIZE = 1 << BITS
SYMBOL = np.zeros(256, bool)
SYMBOL[[*b"#*$%&|<>"]] = True


def _buckets(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Three families of hashed features: (bucket of each occurrence, n + 1 offsets by text).

    Words are folded to lower case; a pair of equal neighbours has bucket 0 of its family; 3-grams keep case.
    """
    _, _, h, firsts = vec.words(data, offsets, fold=True)
    shift = np.uint64(64 - BITS)
    pair, at = vec.shingles(h, firsts, 2)
    both = (pair >> shift).astype(np.int32)
    inner = np.ones(max(0, len(h) - 1), bool)
    limit = firsts[1:-1]
    inner[limit[(limit > 0) & (limit < len(h))] - 1] = False
    same = np.zeros(len(pair), bool)
    counts = np.diff(firsts)
    place = np.flatnonzero(np.repeat(counts > 1, np.where(counts > 1, counts - 1, np.minimum(counts, 1))))
    same[place] = (h[1:] == h[:-1])[inner] if len(h) > 1 else False
    both[same] = 0
    gram = data[:-2].astype(np.uint32) | (data[1:-1].astype(np.uint32) << 8) | (data[2:].astype(np.uint32) << 16) if len(data) > 2 else np.zeros(0, np.uint32)
    gram = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)
    return [((h >> shift).astype(np.int32), firsts), (both, at), (gram, np.minimum(offsets, len(gram)))]


@dataclass
class QualityModel:
    weights: np.ndarray | None  # families x SIZE
    constant: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The calibrated probability of good quality of every text."""
        n = len(offsets) - 1
        if self.weights is None:
            return np.ones(n)
        z = np.full(n, self.constant)
        for w, (bucket, at) in zip(self.weights, _buckets(data, offsets)):
            total = np.concatenate([[0.0], np.cumsum(w[bucket])])
            z += (total[at[1:]] - total[at[:-1]]) / np.maximum(np.diff(at), 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            data, offsets = vec.utf8(part["text"])
            rows = []
            families = _buckets(data, offsets)
            for k in range(len(offsets) - 1):
                index, count = [], []
                for f, (bucket, at) in enumerate(families):
                    c = np.bincount(bucket[at[k] : at[k + 1]], minlength=SIZE)
                    i = np.flatnonzero(c)
                    index.append((i + f * SIZE).astype("<u2"))
                    count.append((c[i] / max(1, at[k + 1] - at[k])).astype("<f4"))
                rows.append((np.concatenate(index).tobytes(), np.concatenate(count).tobytes()))
            yield pa.RecordBatch.from_arrays([part["y"], pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["y", "i", "v"])


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> QualityModel:
    """Fits on at most per_class labelled rows of each class; a fifth of them only calibrates."""
    rows = labelled_sample(docs, labels, "quality", 0, per_class).mapInArrow(_frequencies, "y int, i binary, v binary").collect()  # 2 * per_class texts
    rows.sort(key=lambda r: (r.y, bytes(r.i), bytes(r.v)))
    y = np.array([r.y for r in rows])
    if len(y) < 20 or y.min() == y.max():
        return QualityModel(None)
    x = np.zeros((len(rows), 3 * SIZE), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r.i, "<u2")] = np.frombuffer(r.v, "<f4")
    held = np.arange(len(y)) % 5 == 0
    w, b = fit_wide(x[~held], y[~held])
    slope, shift = fit_logistic((x[held] @ w + b)[:, None], y[held], l2=0.1) if len({*y[held].tolist()}) == 2 else (1.0, 0.0)
    return QualityModel(w.reshape(3, SIZE), b, max(float(slope), 1e-3), float(shift))


def base_counts(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text."""
    starts, ends, h, firsts = vec.words(data, offsets)
    n_words = np.diff(firsts)

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offsets[1:]] - total[offsets[:-1]]

    dup = np.zeros(len(n_words), np.int64)
    for k, text in enumerate(texts.to_pylist()):
        if text and "\n" in text:
            lines = text.split("\n")
            if len(set(lines)) < len(lines):
                dup[k] = sum(c - 1 for line, c in Counter(lines).items() if c > 1 and line.strip(" \t\n\v\f\r"))
    repeat = np.zeros(len(n_words), np.int64)
    window, at = vec.shingles(h, firsts, 5)
    if len(window):
        owner = np.repeat(np.arange(len(n_words)), np.diff(at))
        long = n_words[owner] >= 5
        window, owner, place = window[long], owner[long], (np.arange(at[-1]) - at[owner] + firsts[owner])[long]
        key = vec.mix(window + owner.astype(np.uint64) * np.uint64(vec.BASE))
        ranked = np.sort(key)
        twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        if len(twice):
            hit = np.searchsorted(twice, key)
            hit = twice[np.minimum(hit, len(twice) - 1)] == key
            cover = np.bincount(place[hit], minlength=len(h) + 6)[: len(h) + 6].astype(np.int64)
            cover[5:] -= np.bincount(place[hit], minlength=len(h) + 6)[: len(h) + 1]
            total = np.concatenate([[0], np.cumsum(np.cumsum(cover)[: len(h)] > 0)])
            repeat = total[firsts[1:]] - total[firsts[:-1]]
    return {"n_words": n_words, "word_chars": per_text(vec.WORD[data] & ((data & 0xC0) != 0x80)), "n_symbols": per_text(SYMBOL[data]), "n_dup_lines": dup, "n_repeat_words": repeat}


def judge_documents(docs: DataFrame, labels: DataFrame, per_class: int = 1500, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and p_good of every row of docs (doc_id, text)."""
    model = fit_quality(docs, labels, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                data, offsets = vec.utf8(part["text"])
                base = base_counts(part["text"], data, offsets)
                failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
                p = model.probability(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], *(pa.array(v, pa.int64()) for v in base.values()), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p, pa.float64())],
                    names=["doc_id", *base, "base_failed", "kept", "p_good"],
                )

    return id_text(docs).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_good double")
