"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Restoring: a disguised word (digits or signs for letters, letters drawn out or
spaced out, letters starred out) is a lattice of characters; Viterbi decoding under a character trigram
model, whose counts come from every document, picks the likeliest plain words, which take its place in the text.

Scoring: features are the words of the restored text and their beginnings of 4 to 6 letters.
Those tied to the label by a likelihood-ratio test on the bounded labelled sample
are kept; a small logistic regression over the strongest weight and the number of
distinct hits gives the score. Words are hashed and looked up a batch at a time.

Defined results: null and empty texts have no words and get the score of a text
without hits; every row gives a row; without labelled rows of both classes every
score is 0. Words of any length are decoded.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import vec
from quern.llm.common import chunks, id_text, written
from quern.llm.labelled import fit_logistic, labelled_sample

LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l"}
JOINTS = " .-_*~'’·,/"
WILD = "*"  # stands for any letter
SWAP, DROP, KEEP_REPEAT, ANY = -1.0, -0.5, -1.0, -1.5
_SMALL = "abcdefghijklmnopqrstuvwxyz"
_CODE = {c: k + 1 for k, c in enumerate(_SMALL)}
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
STRIPPED = ".,;:?\"'()[]{}#%&*<>=~`^"  # at the limits of a word
_BYTES = {c: c.encode() for c in [*LOOKS_LIKE, *JOINTS] if c != " "}
_ODD = np.zeros(256, bool)  # signs and joints of one byte; the longer ones are in _BYTES
_ODD[[b[0] for b in _BYTES.values() if len(b) == 1]] = True
_KEPT = np.ones(256, bool)
_KEPT[[*STRIPPED.encode()]] = False
_JOINT = np.zeros(256, bool)  # between letters spaced out, see SPACED
_JOINT[[*b" \t\n\x0b\x0c\r.-_*~", 0xC2]] = True  # 0xC2: the first byte of a space that doesn't break
_BLANK = np.zeros(256, bool)
_BLANK[[*b" \t\n\x0b\x0c\r"]] = True
_ITEM = np.zeros(256, bool)
_ITEM[[*b"@$!|+(", *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_GAP = r"(?:[ \t-\r]+|[\xa0.\-_*~])"
SPACED = re.compile(rf"(?<![^\s])[^\W\d_](?:{_GAP}(?:[^\W_]|[@$!|+(])){{2,}}(?![^\s.,;:!?])")
WORD = re.compile(r"[^\s]+")
_DIGITS = re.compile(r"[0-9]")
_DRAWN = re.compile(r"(.)\1{3,}", re.IGNORECASE | re.DOTALL)


def _plain(c: str) -> str:
    return unicodedata.normalize("NFD", c)[0]


def trigram_counts(words: Iterator[str]) -> np.ndarray:
    """Counts of letter trigrams (0 marks a word's limits, other letters are left out), 27 x 27 x 27."""
    out = np.zeros((27, 27, 27), np.int64)
    for word in words:
        a = b = 0
        for c in word:
            k = _CODE.get(_plain(c), 0)
            if k:
                out[a, b, k] += 1
                a, b = b, k
        out[a, b, 0] += 1
    return out


def _lowered(texts: pa.Array) -> pa.Array:
    """Texts in small letters; bytes that aren't UTF-8 are replaced."""
    try:
        return pc.utf8_lower(texts)
    except pa.ArrowInvalid:
        data, offsets = vec.utf8(texts)
        raw = data.tobytes()
        return pa.array([raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.large_string())


@lru_cache(1)
def _letter_codes() -> np.ndarray:
    """For every code point: 0 for what parts words, 1 to 26 for a plain letter, 27 for another letter."""
    out = np.zeros(0x110000, np.uint8)
    for k in range(0x110000):
        c = chr(k)
        if c.isalnum() and not c.isdecimal():
            out[k] = _CODE.get(_plain(c.lower()), 27)
    return out


def text_trigrams(texts: pa.Array) -> np.ndarray:
    """trigram_counts() over the words (two letters or more) of whole texts, as 27 ** 3 numbers."""
    data, offsets = vec.utf8(texts)
    if not len(data):
        return np.zeros(27**3, np.int64)
    if data.max() > 127:
        data, offsets = vec.utf8(_lowered(texts))
        offsets = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])[offsets]
        data = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    code = np.insert(_letter_codes()[data], offsets, 0)
    letter = code > 0
    lone = np.flatnonzero(letter[1:-1] & ~letter[:-2] & ~letter[2:]) + 1
    code[lone] = 0
    n_words = int(np.count_nonzero((code[1:] > 0) & (code[:-1] == 0)))
    code = code[code != 27].astype(np.int32)
    b, c = code[1:-1], code[2:]
    a = np.where(b > 0, code[:-2], 0)
    at = ((a * 27 + b) * 27 + c)[(b > 0) | (c > 0)]
    out = np.bincount(at, minlength=27**3)
    if code[1]:  # the limit before the first text has no other before it
        out[code[1]] += 1
    out[0] += n_words - int(np.count_nonzero((b > 0) & (c == 0)))  # words of other letters only
    return out


def corpus_trigrams(docs: DataFrame) -> np.ndarray:
    """Letter trigrams of all documents: a sum a task, then one table of at most 27 ** 3 rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, np.int64)
        for batch in batches:
            for part in chunks(batch):
                total += text_trigrams(part["text"])
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total[cell])], names=["cell", "n"])

    rows = id_text(docs).select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(27**3, np.int64)
    out[[r.cell for r in rows]] = [r.n for r in rows]
    return out.reshape(27, 27, 27)


def trigram_logs(counts: np.ndarray) -> np.ndarray:
    """Smoothed log P(letter | two before), backing off to the bigram and to the letter."""
    c1 = counts.sum((0, 1)) + 1.0
    c2 = counts.sum(0)
    p1 = c1 / c1.sum()
    p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
    return np.log((counts + 5 * p2) / (counts.sum(2, keepdims=True) + 5))


def restore(word: str, logs: np.ndarray) -> str:
    """The likeliest plain form of a disguised word, by Viterbi over its lattice.

    Each place offers the letter itself, letters that a sign looks like or stands for, nothing (a joint; all but one or two of a
    run), or, for a joint, the end of a word and the beginning of the next.
    """
    places: list[list[tuple[str, float]]] = []
    k = 0
    while k < len(word):
        c, n = word[k].lower(), 1
        while k + n < len(word) and word[k + n].lower() == c:
            n += 1
        k += n
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, 0.0 if n < 3 else DROP))
            if n > 1:
                options.append((c + c, 0.0 if n == 2 else KEEP_REPEAT))
        options += [(x * k, SWAP) for x in LOOKS_LIKE.get(c, "") for k in range(1, min(n, 2) + 1)]
        if c == WILD:
            options += [(x, ANY) for x in _SMALL]
        if not c.isalpha():
            options.append(("", DROP if c in JOINTS or c.isspace() else 3 * SWAP))
        if c in JOINTS or c.isspace():
            options.append((" ", 0.0))
        places.append(options)
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # the text as a chain of (letters, chain before)
    for options in places:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, text) in best.items():
            for letters, cost in options:
                x, y, s = a, b, score + cost
                for c in letters:
                    code = _CODE.get(_plain(c), 0)
                    if c == " ":
                        s += logs[x, y, 0]
                        x = y = 0
                    elif code:
                        s += logs[x, y, code]
                        x, y = y, code
                if (x, y) not in new or new[x, y][0] < s:
                    new[x, y] = (s, (letters, text))
        best = new
    return max((s + logs[a, b, 0], _joined(t)) for (a, b), (s, t) in best.items())[1]


def _joined(chain: tuple | None) -> str:
    out = []
    while chain:
        letters, chain = chain
        out.append(letters)
    return "".join(reversed(out))


def _core(word: str) -> tuple[int, int, str] | None:
    """Where the part of a word that may be disguised begins and ends, and that part with runs cut to three, which restore() reads
    alike; None if there is none. There is no bound on length."""
    begin, end = len(word) - len(word.lstrip(STRIPPED)), len(word.rstrip(STRIPPED))
    end = max(begin, len(word[:end].rstrip("!")))
    core = _DRAWN.sub(lambda x: x[0][:3], word[begin:end])
    if len(core) < 3 or "=" in core or ":" in core or "@" in core and "." in core:
        return None
    letters, digits = sum(map(str.isalpha, core)), len(_DIGITS.findall(core))
    signs = sum(c in LOOKS_LIKE for c in core)
    if letters < len(core) and (letters > 1 or letters + signs > 2 and signs - digits + letters > 1) and digits <= letters + 1 and all(c.isalpha() or c in LOOKS_LIKE or c in JOINTS for c in core):
        return begin, end, core
    if letters == len(core) >= 5 and any(core[k].lower() == core[k + 1].lower() == core[k + 2].lower() for k in range(len(core) - 2)):
        return begin, end, core
    return None


class Restorer:
    """restore() with a store, for words, texts and whole batches."""

    def __init__(self, logs: np.ndarray):
        self.logs = logs
        self._known = lru_cache(200_000)(lambda w: restore(w, logs))

    def known(self, part: str) -> str:
        return self._known(part) if len(part) <= 64 else restore(part, self.logs)

    def words(self, text: str) -> str:
        """text with its disguised words restored: letters with signs among them, and letters drawn out."""

        def one(m: re.Match) -> str:
            core = _core(m[0])
            return m[0] if core is None else m[0][: core[0]] + self.known(core[2]) + m[0][core[1] :]

        return WORD.sub(one, text)

    def text(self, text: str) -> str:
        """text with its disguised words and letters spaced out restored."""
        return self.words(SPACED.sub(lambda m: self.known(_DRAWN.sub(lambda x: x[0][:3], m[0])), text))

    def batch(self, texts: pa.Array) -> dict[int, str]:
        """text() of the texts that it changes, by their numbers.

        The bytes are screened by the classes that text() uses, and only words and texts that may hold something are decoded:
        words with a sign or joint within their stripped limits, words with a byte sequence three times in a row, texts with
        single characters between joints. texts: in small letters, see _lowered().
        """
        data, offsets = vec.utf8(texts)
        out: dict[int, str] = {}
        if len(data) < 3:
            return out
        raw = data.tobytes()
        starts, ends, spaced = _suspects(data, offsets)
        whole = set(spaced.tolist())
        for k in sorted(whole):
            old = raw[offsets[k] : offsets[k + 1]].decode("utf-8", "replace")
            if (new := self.text(old)) != old:
                out[k] = new
        owner = np.searchsorted(offsets, starts, side="right") - 1
        cuts: dict[int, list[tuple[int, int, bytes]]] = {}
        for k, a, z in zip(owner.tolist(), starts.tolist(), ends.tolist()):
            if k not in whole:
                old = raw[a:z].decode("utf-8", "replace")
                if (new := self.words(old)) != old:
                    cuts.setdefault(k, []).append((a, z, new.encode("utf-8", "replace")))
        for k, some in cuts.items():
            at, parts = int(offsets[k]), []
            for a, z, new in some:
                parts += [raw[at:a], new]
                at = z
            out[k] = b"".join([*parts, raw[at : offsets[k + 1]]]).decode("utf-8", "replace")
        return out


def _suspects(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words that may be disguised, and the numbers of texts that may have letters spaced out."""
    low = vec.LOWER[data]
    wide = bool(data.max() > 127)

    # letters spaced out; the first byte of a character stands for it, and one blank for several
    lead = np.flatnonzero((data & 0xC0 != 0x80) & ~np.concatenate([[False], _BLANK[data[1:]] & _BLANK[data[:-1]]]))
    first = data[lead]
    spaced = np.zeros(0, np.int64)
    if len(first) > 4:
        item, joint = _ITEM[first], _JOINT[first]
        mark = _ALPHA[first[:-4]] & joint[1:-3] & item[2:-2] & joint[3:-1] & item[4:]
        mark[1:] &= vec.SPACE[first[:-5]] | (first[:-5] < 32) | (first[:-5] > 127) | np.isin(lead[1 : len(mark)], offsets)
        spaced = np.unique(np.searchsorted(offsets, lead[np.flatnonzero(mark)], side="right") - 1)

    # words with signs or joints, and words drawn out
    odd = _ODD[data]
    if wide:
        for sign in (b for b in _BYTES.values() if len(b) > 1):
            hit = data[: len(data) - len(sign) + 1] == sign[0]
            for k in range(1, len(sign)):
                hit &= data[k : len(data) - len(sign) + 1 + k] == sign[k]
            odd[np.flatnonzero(hit)] = True
    starts, ends = vec.pieces(vec.WORD[data], vec.limits(len(data), offsets))
    of = lambda places: np.unique(np.searchsorted(starts, places, side="right") - 1)
    words = of(np.flatnonzero(odd))
    kept = np.flatnonzero(_KEPT[data] & vec.WORD[data])
    a, z = np.searchsorted(kept, starts[words]), np.searchsorted(kept, ends[words])
    words, a, z = words[a < z], kept[a[a < z]], kept[z[a < z] - 1] + 1
    count = lambda mask: (total := np.concatenate([[0], np.cumsum(mask)]))[z] - total[a]
    letters, digits, odds = count(_ALPHA[data]), count((data >= 48) & (data <= 57)), count(odd)
    chosen = [words[(odds > 0) & (letters + odds > 1) & (digits <= letters + 1)]]
    for n in (1, 2, 3, 4) if wide else (1,):  # bytes of a character
        if len(data) >= 3 * n:
            same = low[n:] == low[:-n]
            run = same[n:] & same[:-n] & _ALPHA[data[: -2 * n]]
            for k in range(1, n):
                run[:-k] &= same[n + k :] & same[k : -n]
                run[-k:] = False
            chosen.append(of(np.flatnonzero(run)))
    chosen = np.unique(np.concatenate(chosen))
    chosen = chosen[chosen >= 0]
    return starts[chosen], ends[chosen], spaced


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features of each letter run, and the text of each: the run, and its first 4, 5 and 6 bytes if it's longer."""
    low = vec.LOWER[data]
    starts, ends = vec.pieces(_ALPHA[data], vec.limits(len(data), offsets))
    keep = ends - starts >= 3
    starts, ends = starts[keep], ends[keep]
    owner = np.searchsorted(offsets, starts, side="right") - 1
    keys, owners = [vec.span_hashes(low, starts, ends)], [owner]
    for n in (4, 5, 6):
        long = ends - starts > n
        keys.append(vec.span_hashes(low, starts[long], starts[long] + n) ^ np.uint64(n))
        owners.append(owner[long])
    return np.concatenate(keys) >> np.uint64(24), np.concatenate(owners)  # 40 bits


def features(texts: pa.Array, restorer: Restorer) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of the restored texts, and the texts they are in."""
    texts = _lowered(pc.fill_null(texts, ""))
    new = restorer.batch(texts)
    if new:
        texts = pa.array([new.get(k, t) for k, t in enumerate(texts.to_pylist())], texts.type)
    return _runs(*vec.utf8(texts))


def _distinct(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort([keys, owners])
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    return keys[new], owners[new]


@dataclass
class ToxicModel:
    logs: np.ndarray = field(default_factory=lambda: np.zeros((27, 27, 27)))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    logistic: np.ndarray | None = None

    def prepared(self) -> ToxicModel:
        self.restorer = Restorer(self.logs)
        self.screen = np.zeros(1 << 16, bool)
        self.screen[(self.keys >> np.uint64(24)).astype(np.int64)] = True
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("restorer", "screen")}

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """For every text: the largest weight of its features, and the logarithm of 1 + its distinct hits."""
        out = np.zeros((len(texts), 2))
        if not len(self.keys):
            return out
        if not hasattr(self, "restorer"):
            self.prepared()
        keys, owners = features(texts, self.restorer)
        hit = self.screen[(keys >> np.uint64(24)).astype(np.int64)]
        keys, owners = keys[hit], owners[hit]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        same = self.keys[at] == keys
        pairs = np.unique(owners[same] * len(self.keys) + at[same])
        owner, at = pairs // len(self.keys), pairs % len(self.keys)
        np.maximum.at(out[:, 0], owner, self.weights[at])
        out[:, 1] = np.log1p(np.bincount(owner, minlength=len(texts)))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.logistic is None:
            return np.zeros(len(texts))
        w = self.logistic
        return 1 / (1 + np.exp(-np.clip(self.evidence(texts) @ w[:2] + w[2], -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, fold: int = 5, per_class: int = 3000, least_g: float = 14.0) -> ToxicModel:
    """Fits on at most per_class labelled rows of each class, none of them in the held-out fold (crc32(doc_id) mod fold = 0).

    The character model has no labels and counts every document.
    """
    sample = written(labelled_sample(docs, labels, "toxic", fold, per_class), "sample")
    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(n) < 2:
        return ToxicModel()
    logs = trigram_logs(corpus_trigrams(docs))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(logs)
        for batch in batches:
            for part in chunks(batch):
                keys, owners = _distinct(*features(part["text"], restorer))
                yield pa.RecordBatch.from_arrays([part["y"].take(pa.array(owners)), pa.array(keys.view(np.int64))], names=["y", "key"])

    found = sample.mapInArrow(read, "y int, key long").groupBy("key").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0")).where("c1 >= 3")
    c1, c0, n1, n0 = F.col("c1"), F.col("c0"), F.lit(float(n[1])), F.lit(float(n[0]))
    p = (c1 + c0) / (n1 + n0)
    part = lambda c, q: F.when(c > 0, c * F.log(c / q)).otherwise(0.0)
    g = 2 * (part(c1, n1 * p) + part(c0, n0 * p) + part(n1 - c1, n1 * (1 - p) + 1e-9) + part(n0 - c0, n0 * (1 - p) + 1e-9))
    weight = F.log((c1 + 0.5) / (n1 + 1)) - F.log((c0 + 0.5) / (n0 + 1))
    chosen = found.select("key", g.alias("g"), weight.alias("weight")).where((F.col("g") >= least_g) & (F.col("weight") > 2)).select("key", "weight").toPandas()  # of 2 * per_class texts
    chosen = chosen.sort_values("key")
    model = ToxicModel(logs, chosen["key"].to_numpy(np.int64).view(np.uint64), chosen["weight"].to_numpy(float))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunks(batch):
                x = model.evidence(some["text"])
                yield pa.RecordBatch.from_arrays([some["y"], pa.array(x[:, 0]), pa.array(x[:, 1])], names=["y", "most", "hits"])

    rows = sample.mapInArrow(weigh, "y int, most double, hits double").toPandas().sort_values(["y", "most", "hits"])  # 2 * per_class rows
    model.logistic = fit_logistic(rows[["most", "hits"]].to_numpy(float), rows["y"].to_numpy(np.int64), l2=0.01)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, fold: int = 5, per_class: int = 3000) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text)."""
    model = fit_toxicity(docs, labels, fold, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                p = model.score(part["text"])
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % fold == 0, F.lit(False)).alias("held_out")
    return id_text(docs, held).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def clean_documents(docs: DataFrame, labels: DataFrame, fold: int = 5, per_class: int = 3000) -> DataFrame:
    """docs without the rows predicted toxic; all columns stay."""
    model = fit_toxicity(docs, labels, fold, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield part.filter(pa.array(model.score(part["text"]) < 0.5))

    return docs.mapInArrow(run, docs.schema)
