"""Fast exact use of a BPE tokenizer file whose pieces never cross white space.

Calling the tokenizers library for running text costs microseconds a word. Its
result for a word doesn't depend on the words around it when the pre-tokenizer
drops white space, so each distinct piece of a word is encoded once by the library
and kept; running text is then a gather from a pool of ids.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from quern.llm import vec

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|>"]] = True


class Pool:
    """Ids of distinct pieces, end to end, found by the pieces' 64-bit hashes for whole arrays of spans.

    limit: past so many pieces it starts anew (this bounds memory and changes no result).
    """

    def __init__(self, limit: int = 1_000_000):
        self.limit = limit
        self.reset()

    def reset(self) -> None:
        self.known = vec.Table()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)
        self.used = 0

    def add(self, keys: np.ndarray, found: list[list[int]]) -> None:
        n, m = self.known.count, sum(map(len, found))
        while self.used + m > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(found) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[self.used : self.used + m] = [i for ids in found for i in ids]
        self.at[n + 1 : n + len(found) + 1] = self.used + np.cumsum([len(ids) for ids in found])
        self.used += m
        self.known.add(keys)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, encode: Callable[[str], list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all spans, end to end, and the number of ids before each span (and after the last)."""
        if self.known.count > self.limit:
            self.reset()
        slot = self.known.find(keys)
        lost = np.flatnonzero(slot < 0)
        if len(lost):
            fresh, first = np.unique(keys[lost], return_index=True)
            raw, at = data.tobytes(), lost[first]
            self.add(fresh, [encode(raw[a:b].decode("utf-8", "replace")) for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            slot[lost] = self.known.find(keys[lost])
        begin = self.at[slot]
        counts = self.at[slot + 1] - begin
        done = np.concatenate([[0], np.cumsum(counts)])
        return self.flat[np.arange(done[-1]) + np.repeat(begin - done[:-1], counts)], done


def after_letters(data: np.ndarray) -> np.ndarray:
    """Where ASCII punctuation (no apostrophe) follows an ASCII or Latin-1 letter; for places 1 to n - 1."""
    letter = _LETTER[data[:-1]]
    letter[1:] |= (data[:-2] == 0xC3) & (data[1:-1] >= 0x80) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
    return letter & _PUNCT[data[1:]]


class WordEncoder:
    """ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = json.dumps(spec.get("normalizer") or {})
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        first = pre[0] if pre else {}
        self.local = first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and "\\s\\p{L}\\p{N}" in json.dumps(first).replace("\\\\", "\\")
        self.lower = '"Lowercase"' in kinds
        self.model = self.tokenizer.model
        byte_level = len(pre) == 2 and pre[1].get("type") == "ByteLevel" and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex")
        self.plain = self.local and self.lower and byte_level and '"NFC"' in kinds
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = iter(range(256, 512))
        self.shown = [chr(b) if b in shown else chr(next(rest)) for b in range(256)]
        self.vocab = self.tokenizer.get_vocab_size()
        self.pool = Pool()

    def _encode_piece(self, text: str) -> list[int]:
        """One piece of a word; letters only need no normalising and splitting by the library, only its merges."""
        if self.plain:
            small = text.lower()
            if small.isalpha() and "Σ" not in text:
                if small.isascii():
                    return [t.id for t in self.model.tokenize(small)]
                if unicodedata.is_normalized("NFC", text):
                    return [t.id for t in self.model.tokenize("".join([self.shown[b] for b in small.encode()]))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), end to end, and n + 1 offsets by text."""
        data, offsets = vec.utf8(texts)
        if not self.local:
            ids = [self.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
            return np.array([i for x in ids for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        # A piece ends at white space, and where ASCII punctuation follows a letter: the library's pattern never crosses either.
        limit = vec.limits(len(data), offsets)
        if len(data) > 2:
            limit[1:-1] |= after_letters(data)
        starts, ends = vec.pieces(vec.WORD[data], limit)
        keys = vec.span_hashes(vec.LOWER[data] if self.lower else data, starts, ends)
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # "<|": perhaps a special token, whose case counts
        if len(special):
            which = np.unique(np.searchsorted(starts, special, side="right") - 1)
            keys[which] = vec.span_hashes(data, starts[which], ends[which]) ^ np.uint64(0xABCDEF)
        ids, done = self.pool.ids(data, starts, ends, keys, self._encode_piece)
        return ids, done[np.searchsorted(starts, offsets)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
