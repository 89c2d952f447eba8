"""Byte-level BPE encoding and decoding: longest matches, backtracking, linear time.

Bytes are mapped to Latin-1 characters so that pyahocorasick can hold the
vocabulary as a trie, which gives the longest token that starts at a place (its
longest path, shortened to a token). Encoding goes left to right: take the longest token whose pair with the one before it is compatible (BPE
would keep the border between the two), else a shorter one, else go back. A place
found to be a dead end is never tried again, and pair checks are kept, so the work
is linear in the piece; the result is that of applying the merges in rank order.

Whole texts go through arrays: spans that no match of the pattern crosses are found
in numpy and looked up in a pool of pieces met before; only new ones are encoded.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quern.llm import vec
from quern.llm.common import chunks, id_text, split
from quern.llm.wordbpe import Pool, after_letters

#: The pattern whose spans are known; any other is applied text by text.
GPT2 = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_RARE = np.zeros(256, bool)
_RARE[[0x1C, 0x1D, 0x1E, 0x1F, 0xE1, 0xE2, 0xE3]] = True  # control characters, and first bytes of white space beyond Latin-1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class ByteBpe:
    """ids of byte strings under ranks, as merging the lowest-ranked pair again and again gives them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = 1_000_000):
        self.ranks = ranks
        self.pattern, self.by_spans = regex.compile(pattern), pattern == GPT2
        self.token = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for rank, token in self.token.items()}
        self.longest = max(self.size.values(), default=0)
        listed = [self.token.get(k) for k in range(max(self.token, default=-1) + 1)]
        self.tokens = pa.array(listed, pa.large_binary())
        self.decimals = pa.array([f"{k} ".encode() for k in range(len(listed))], pa.large_binary())
        self.compatible: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.made_of: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        self.trie = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.trie.add_word(token.decode("latin-1"), rank)
            self.shorter[rank] = next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), -1)
        for rank in sorted(self.token):
            token, left = self.token[rank], self.shorter[rank]
            self.made_of[rank] = (rank, rank)
            while left >= 0:
                right = ranks.get(token[self.size[left] :], -1)
                if 0 <= right < rank and left < rank and self._joined(left, right):
                    self.merge[left, right] = rank
                    self.made_of[rank] = (left, right)
                    break
                left = self.shorter[left]
        self.pool = Pool(kept)

    def _joined(self, left: int, right: int) -> bool:
        """Whether BPE over the two tokens' bytes keeps the border between them until both are whole.

        Undoes merges from the latest back; if the parts that face each other at some moment form a merge that came before
        either side was finished, BPE would have taken it instead.
        """
        bar = 1 << 62
        while True:
            across = self.merge.get((left, right))
            if across is not None and across < bar:
                return False
            turn_left = left > right
            for _ in range(2):
                if turn_left:
                    bar, inner = left, self.made_of[left][1]
                    done, left = inner == left, inner
                else:
                    bar, inner = right + 1, self.made_of[right][0]
                    done, right = inner == right, inner
                if not done:
                    break
                turn_left = not turn_left
            else:
                return True

    def fits(self, left: int, right: int) -> bool:
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            known = self.compatible[left, right] = self._joined(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, chars, prefix, get = len(piece), piece.decode("latin-1"), self.trie.longest_prefix, self.ranks.get

        def longest(at: int) -> int:
            most = prefix(chars[at : at + self.longest])
            while most:
                rank = get(piece[at : at + most])
                if rank is not None:
                    return rank
                most -= 1
            return -1

        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest(0) if n else -1
        while at < n:
            if token >= 0:
                end = at + self.size[token]
                if alive[end] and (not out or self.fits(out[-1], token)):
                    out.append(token)
                    at = end
                    token = longest(at) if at < n else -1
                else:
                    token = self.shorter[token]
            else:
                if not out:
                    raise ValueError("a byte of the text is not in the vocabulary")
                alive[at] = 0
                last = out.pop()
                at -= self.size[last]
                token = self.shorter[last]
        return out

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            ids += self.encode_piece(piece.encode())
        return ids

    def _encode_span(self, span: str) -> list[int]:
        body = span[1:] if span[:1] == " " else span
        return self.encode_piece(span.encode()) if body.isalpha() else self.encode(span)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), end to end, and n + 1 offsets by text."""
        data, offsets = vec.utf8(texts)
        n = len(offsets) - 1
        rare = np.flatnonzero(_RARE[data])
        rare = np.concatenate([rare, np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0)))])
        slow = np.zeros(n, bool)
        slow[np.searchsorted(offsets, rare, side="right") - 1] = True
        if not self.by_spans:
            slow[:] = True
        if not slow.any():
            return self._encode_plain(data, offsets)
        out, sizes = [], []
        edges = np.flatnonzero(np.diff(slow, prepend=not slow[0]))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), n]):
            if slow[a]:
                found = [self.encode(t or "") for t in texts.slice(a, b - a).to_pylist()]
                out += [np.array(x, np.uint32) for x in found]
                sizes.append(np.array([len(x) for x in found]))
            else:
                ids, at = self._encode_plain(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out.append(ids)
                sizes.append(np.diff(at))
        return np.concatenate(out), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def _encode_plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts whose only white space is ASCII. A span is a word with the one space before it, cut where punctuation follows a
        letter, or white space: of a run before a word, all but the last character, and the last unless it's that space."""
        n = len(data)
        if n < 3:
            found = [self.encode(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(offsets[:-1], offsets[1:])]
            return np.array([i for x in found for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        word = vec.WORD[data]
        limit = vec.limits(n, offsets)
        edge = limit.copy()
        turn = word[1:] & ~word[:-1] & ~limit[1:n]  # a word begins at this place, after white space of its text
        spaced = turn & (data[:-1] == 32)
        edge[1:n] |= word[1:] != word[:-1]
        edge[1:n] |= after_letters(data)
        edge[1:n] &= ~spaced | limit[1:n]
        edge[: n - 1] |= turn  # the last white space before a word starts a span of its own
        cut = np.flatnonzero(edge)
        starts, ends = cut[:-1], cut[1:]
        keys = vec.span_hashes(data, starts, ends)
        ids, done = self.pool.ids(data, starts, ends, keys, self._encode_span)
        return ids, done[np.searchsorted(starts, offsets)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def _joined(values: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """values[ids] end to end, and the n + 1 offsets of the texts in it."""
    taken = values.take(pa.array(ids))
    at = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    return memoryview(taken.buffers()[2] or b"") if len(ids) else memoryview(b""), at[offsets]


_MADE: dict[tuple[str, str], ByteBpe] = {}


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """One encoder a Python worker, file and pattern."""
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _MADE[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encodes docs (doc_id, text) and decodes the ids again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by a space), decoded_sha256 and, with with_ids, ids (array
    of int). Null and empty texts have no ids; each row gives a row, whatever its doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = byte_bpe(path, pattern), hashlib.sha256
        for batch in batches:
            for part in chunks(batch, "text", 1 << 21):
                ids, offsets = bpe.encode_texts(part["text"])
                listed, at = _joined(bpe.decimals, ids, offsets)
                decoded, place = _joined(bpe.tokens, ids, offsets)
                columns = {
                    "doc_id": part["doc_id"],
                    "n_tokens": pa.array(np.diff(offsets), pa.int64()),
                    "ids_sha256": pa.array([sha(listed[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string()),
                    "decoded_sha256": pa.array([sha(x).hexdigest() for x in split(decoded, place)], pa.string()),
                }
                if with_ids:
                    columns["ids"] = pa.array([x.astype(np.int32) for x in split(ids, offsets)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
