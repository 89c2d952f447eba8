"""Vectorised text primitives shared by the corpus operators.

Everything here works on a whole Arrow string chunk at once: the UTF-8 buffer is
viewed as bytes, word limits come from boolean masks, and word hashes come from
8-byte steps over all words at once (arithmetic mod 2**64), so no Python object is
made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(0x5EED)
LETTER = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
WORD = ~SPACE
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, np.uint64(base), np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and the n + 1 offsets; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def limits(n: int, offsets: np.ndarray) -> np.ndarray:
    """A mask of n + 1 places, true where a text begins or ends."""
    out = np.zeros(n + 1, bool)
    out[offsets] = True
    out[0] = out[n] = True
    return out


def pieces(is_part: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of is_part, none of which crosses a limit (a mask of n + 1 places)."""
    n = len(is_part)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = is_part[1:] != is_part[:-1]
    edge |= limit[1:n]
    first = is_part.copy()
    first[1:] &= edge
    last = is_part.copy()
    last[:-1] &= edge
    return np.flatnonzero(first), np.flatnonzero(last) + 1


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_LONG = 128


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for every span, by steps of 8 bytes; spans over 128 bytes by a polynomial."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(BASE))
    if not len(starts):
        return out
    padded = np.zeros(len(data) // 8 * 8 + 24, np.uint8)
    padded[: len(data)] = data
    grid = padded.view("<u8")
    act = np.flatnonzero(size <= _LONG)
    at, left = starts[act], size[act]
    while len(act):
        cell, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        value = (grid[cell] >> shift) | ((grid[cell + 1] << (np.uint64(63) - shift)) << np.uint64(1))
        value &= _KEEP[np.minimum(left, 8)]
        out[act] = mix((out[act] ^ value) * np.uint64(0x9FB21C651E98DF25))
        more = left > 8
        act, at, left = act[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > _LONG):
        part = LETTER[data[starts[k] : ends[k]]]
        total = np.uint64(0)
        for a in range(0, len(part), 1 << 16):
            block = part[a : a + (1 << 16)]
            total = mix(np.add.reduce(block * powers(BASE, len(block)), keepdims=True) + total)[0]
        out[k] = total ^ out[k]
    return out


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: starts, ends, hashes, and for each text the number of the first of its words (n + 1 values)."""
    starts, ends = pieces(WORD[data], limits(len(data), offsets))
    return starts, ends, span_hashes(LOWER[data] if fold else data, starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, firsts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of each text (a shorter text gives its whole sequence as one), and n + 1 offsets by text."""
    counts = np.diff(firsts)
    out = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(out)])
    if not offsets[-1]:
        return np.zeros(0, np.uint64), offsets
    at = np.arange(offsets[-1]) + np.repeat(firsts[:-1] - offsets[:-1], out)
    left = np.repeat(counts, out)
    total = np.zeros(len(at), np.uint64)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    for k in range(n):
        part = padded[at + k] * powers(0xD6E8FEB86659FD93, n + 1)[k + 1]
        total += np.where(left > k, mix(part + np.uint64(k + 1)), np.uint64(0))
    return mix(total + left.clip(max=n).astype(np.uint64)), offsets


class Table:
    """64-bit keys to their numbers in order of arrival, looked up for whole arrays (open addressing)."""

    def __init__(self, bits: int = 16):
        self.bits, self.count = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.slots = np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it isn't known."""
        out = np.full(len(keys), -1, np.int64)
        step, mask = np.uint64(64 - self.bits), np.int64((1 << self.bits) - 1)
        where = np.arange(len(keys))
        at = ((keys * np.uint64(BASE)) >> step).astype(np.int64)
        while len(where):
            slot = self.slots[at]
            same = (self.keys[at] == keys[where]) & (slot >= 0)
            out[where[same]] = slot[same]
            on = ~same & (slot >= 0)
            where, at = where[on], (at[on] + 1) & mask
        return out

    def add(self, keys: np.ndarray) -> None:
        """New distinct keys; they get the next numbers."""
        if (self.count + len(keys)) * 3 > len(self.keys):
            known = np.zeros(self.count, np.uint64)
            known[self.slots[self.slots >= 0]] = self.keys[self.slots >= 0]
            grown = Table(max(self.bits + 1, int((self.count + len(keys)) * 4).bit_length()))
            grown.add(known)
            self.__dict__ = grown.__dict__
        step, mask = np.uint64(64 - self.bits), np.int64((1 << self.bits) - 1)
        number = np.arange(self.count, self.count + len(keys))
        at = ((keys * np.uint64(BASE)) >> step).astype(np.int64)
        self.count += len(keys)
        while len(keys):
            free = self.slots[at] < 0
            self.slots[at[free]] = number[free]
            won = np.zeros(len(keys), bool)
            won[free] = self.slots[at[free]] == number[free]
            self.keys[at[won]] = keys[won]
            keys, number, at = keys[~won], number[~won], (at[~won] + 1) & mask
