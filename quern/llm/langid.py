"""Language ID: each text as a mixture of languages, by expectation-maximisation.

The languages' models are hashed byte 3-gram frequencies, counted over every
training row: sums a task, then a table of a bounded size a language. A text's units are
its words, whose likelihood under a language is the product of its 3-grams'
(tempered, as they overlap). EM finds the proportions; the set of languages is the
one of the nested sets "k largest" with the best penalised likelihood. All texts of
an Arrow chunk are iterated together by array operations, until no proportion moves by more than `close`.

Defined results: a text that is null, or has no letter, is `und` with score 0; so is
every text when there is no training row. Ties go to the language first in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import vec
from quern.llm.common import chunks, id_text

BITS = 16
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLASS = vec.LOWER.copy()
_CLASS[~_LETTER] = 32


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bucket of the 3-gram around each byte (lower case; all but letters are a space, and so are a text's limits)."""
    x = np.full(len(data) + 2, 32, np.uint32)
    x[1:-1] = _CLASS[data]
    before, after = x[:-2].copy(), x[2:].copy()
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = 32
    after[offsets[1:][full] - 1] = 32
    return (((before | (x[1:-1] << 8) | (after << 16)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)


@dataclass
class LanguageModel:
    languages: list[str]
    logs: np.ndarray  # languages x buckets
    temper: float = 0.5
    penalty: float = 2.0
    close: float = 1e-4
    rounds: int = 200  # an end for cycles of rounding

    def mixtures(self, texts: pa.Array) -> np.ndarray:
        """The proportions of the selected languages of every text (rows of zeros: no letter)."""
        data, offsets = vec.utf8(texts)
        n, k = len(offsets) - 1, len(self.languages)
        out = np.zeros((n, k))
        starts, ends = vec.pieces(_LETTER[data], vec.limits(len(data), offsets))
        if not len(starts) or not k:
            return out
        gram = _grams(data, offsets)
        like = np.empty((len(starts), k))
        for j in range(k):
            total = np.concatenate([[0.0], np.cumsum(self.logs[j][gram], dtype=np.float64)])
            like[:, j] = total[ends] - total[starts]
        like *= self.temper
        top = like.max(1, keepdims=True)
        like = np.exp(like - top)
        first = np.searchsorted(starts, offsets)
        has = np.flatnonzero(np.diff(first))
        size = np.diff(first)[has].astype(float)
        owner, at = np.repeat(np.arange(len(has)), np.diff(first)[has]), first[:-1][has]

        def em(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Proportions where they have settled, and the likelihood there; settled texts are left out as it goes on."""
            share = share.copy()
            live, rows, part_like = np.arange(len(has)), np.arange(len(owner)), like
            for k in range(self.rounds):
                lengths = np.diff(np.append(at, len(owner)))[live]
                begin = np.cumsum(lengths) - lengths
                now = share[live]
                part = part_like * np.repeat(now, lengths, axis=0)
                part /= np.maximum(part.sum(1, keepdims=True), 1e-300)
                new = np.add.reduceat(part, begin) / size[live][:, None]
                share[live] = new
                moving = np.abs(new - now).max(1) > self.close
                if not moving.any():
                    break
                if moving.mean() < 0.7:
                    keep = np.repeat(moving, lengths)
                    live, rows = live[moving], rows[keep]
                    part_like = like[rows]
            return share, np.add.reduceat(np.log(np.maximum((like * share[owner]).sum(1), 1e-300)), at)

        whole, _ = em(np.full((len(has), k), 1 / k))
        order = np.argsort(-whole, axis=1, kind="stable")
        best, value = None, None
        for m in range(1, k + 1):
            mask = np.zeros_like(whole, bool)
            np.put_along_axis(mask, order[:, :m], True, 1)
            share = np.where(mask, whole + 0.05, 0)  # from near nothing, the steps would be too small to tell from none
            share /= share.sum(1, keepdims=True)
            share, score = em(share)
            score = score - self.penalty * (m - 1) * np.log(size + 1)
            if best is None:
                best, value = share, score
            else:
                better = score > value
                best[better], value = share[better], np.where(better, score, value)
                if not better.any():
                    break
        out[has] = best
        for t in has[np.add.reduceat((data[starts] < 128).astype(int), at) == 0].tolist():  # only bytes beyond ASCII: perhaps no letter
            if not any(map(str.isalpha, texts[t].as_py() or "")):
                out[t] = 0
        return out


def fit_languages(docs: DataFrame, fold: int = 4, held: int = 2) -> LanguageModel:
    """Models from text and lang of all rows with crc32(doc_id as text) mod fold != held."""
    key = F.col("doc_id").cast("long")
    rows = docs.select(key.alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(key.cast("string")) % fold != held))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in chunks(batch):
                data, offsets = vec.utf8(part["text"])
                gram, letter = _grams(data, offsets), _LETTER[data]
                lang = part["lang"].dictionary_encode()
                text_of = np.repeat(lang.indices.to_numpy(zero_copy_only=False), np.diff(offsets))
                for k, name in enumerate(lang.dictionary.to_pylist()):
                    found = np.bincount(gram[letter & (text_of == k)], minlength=1 << BITS)
                    total[name] = total[name] + found if name in total else found
        for name, n in total.items():
            cell = np.flatnonzero(n) if n.any() else np.zeros(1, np.int64)  # a language without letters is known too
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cell), pa.string()), pa.array(cell, pa.int32()), pa.array(n[cell])], names=["lang", "cell", "n"])

    sums = rows.select("lang", "text").mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()  # 1 << BITS rows a language at most
    if not sums.num_rows:
        return LanguageModel([], np.zeros((0, 1 << BITS)))
    lang = sums["lang"].combine_chunks().dictionary_encode()
    languages = sorted(lang.dictionary.to_pylist())
    place = np.array([languages.index(x) for x in lang.dictionary.to_pylist()])
    table = np.zeros((len(languages), 1 << BITS))
    table[place[lang.indices.to_numpy(zero_copy_only=False)], sums["cell"].to_numpy()] = sums["n"].to_numpy()
    shared = table.sum(0) + 0.1
    shared /= shared.sum()
    logs = np.log((table + 50 * shared) / (table.sum(1, keepdims=True) + 50))
    return LanguageModel(languages, logs.astype(np.float32))


def identify_documents(docs: DataFrame, fold: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score and languages ("xx:share,...", largest first) of every row of docs (doc_id, text, lang)."""
    model = fit_languages(docs, fold, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                share = model.mixtures(part["text"])
                if not model.languages:
                    share = np.zeros((part.num_rows, 1))
                top, best = share.argmax(1), np.clip(share.max(1), 0, 1)
                names = [model.languages[k] if s > 0 else "und" for k, s in zip(top.tolist(), best.tolist())]
                listed = [",".join(f"{model.languages[j]}:{row[j]:.4f}" for j in np.argsort(-row, kind="stable") if row[j] > 0) for row in share]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(names, pa.string()), pa.array(best, pa.float64()), pa.array(listed, pa.string())], names=["doc_id", "held_out", "lang_pred", "score", "languages"])

    is_held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % fold == held, F.lit(False)).alias("held_out")
    return id_text(docs, is_held).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, languages string")
