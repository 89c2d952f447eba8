"""N-gram Jaccard join by PartEnum signatures: all pairs of texts with similarity >= percent / 100, exactly.

Sets of shingle hashes with equal content are one class. Sizes are cut into bands,
each as wide as the threshold allows; a set signs for its own band and the next, so
two similar sets share a band. In a band the hash domain is cut into n1 groups of n2
parts; a signature is what a set has in n2 - k2 parts of one group, for every such
subset (`SHAPES`). Only signatures of `least` or more elements that aren't common (counted
over all rows, by 32 bits of their hash) are sent, so boilerplate makes no hot key.

What that loses is counted. To spoil all of a set's signatures in a group, so many of
its parts must differ (`guards`); a similar set differs in no more than k places. A set
whose groups hold more than k in sum shares a signature with every similar set. Where
a signature is in more than `crowd` sets, these aren't paired by it, which takes one
off the sum of each. So pairs by a signature are bounded whatever the size of the data, and
candidates grow with the signatures, not with their square. Sets whose sum falls to k
or less sign again in a second round with larger signatures (n2, k2 = 6, 3). A pair is
found in the first round in which one of the two has enough.

Pairs of two sets that fall short again are never listed (`crowded`): these sets have nearly
everything in common with more than `crowd` others. Their elements are counted exactly; two
similar sets share an element of their prefixes (rarest first), and a set's home is one
of these elements. A home's sets are held against all sets that share a prefix element with
one of them, as blocks of a matrix product, which gives each set the number of its links
and a forest of them. This part is prefix filtering, not PartEnum.

Signatures travel as packed blocks, 6 bytes each with the number of the signer; what a signer is goes once, and is joined to
pairs of numbers, so a signature takes as much whatever the number of buckets. Of a class's copies that of the lowest id
signs (`first_copies`; others may, which makes work, not errors). A band's share of all signatures says
into how many places its groups are cut, and places go to buckets in turn, so buckets
are alike whatever the lengths of the texts. Candidates pass an exact bound on
the difference (parity sketches of 2 bits an element), then sets are compared.
Sets of survivors are sent once to the smallest neighbour's group, large groups cut
into blocks. Links are between classes, never between copies; components come from
large-star and small-star steps over the links.

Defined results: null and empty texts, and those without words, are linked with nothing;
null doc_ids are rows of their own and name no component; repeated rows are rows of one class; texts
of any length are compared whole; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import vec
from quern.llm.common import chunks, written

NONE = -(2**63)
#: Elements a group where sets have the band's lowest size, parts of a group, of them left out, and elements that a signature needs.
SHAPES = ((3.0, 3, 1, 1), (4.5, 6, 3, 2))
LAST = len(SHAPES)
PLACES = 8  # of a bucket


def sets_of(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text, end to end, and n + 1 offsets."""
    data, offsets = vec.utf8(texts)
    _, _, h, firsts = vec.words(data, offsets, fold=True)
    grams, at = vec.shingles(h, firsts, n)
    parts, sizes = [], np.zeros(len(at) - 1, np.int64)
    for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if b > a:
            own = np.unique(grams[a:b])
            sizes[k] = len(own)
            parts.append(own)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def class_keys(elements: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 63-bit name of each set, as even signed integers above the lowest."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(vec.mix(elements ^ np.uint64(0xA5A5A5A5)))])
    name = vec.mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64))
    return np.maximum((name & ~np.uint64(1)).view(np.int64), NONE + 2)


@lru_cache(8)
def bands(percent: int) -> np.ndarray:
    """The lowest size of each band: in a band no size is more than 100 / percent times another."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * 100 // percent + 1)
    return np.array(low)


def groups_of(low: np.ndarray, level: int) -> np.ndarray:
    """n1 of the bands with these lowest sizes."""
    each = np.where(low < 16, min(2.5, SHAPES[level][0]), SHAPES[level][0])
    return np.ceil(low / each).astype(np.int64) + 1


def guards(rare: np.ndarray, k2: int, least: int) -> np.ndarray:
    """How many parts of each group (rows: elements in its parts that aren't common) must differ to spoil all of its signatures
    of n2 - k2 parts with `least` such elements: the fullest parts are the ones to spoil first."""
    m = rare.shape[1] - k2
    total = np.concatenate([np.zeros((len(rare), 1), np.int64), np.cumsum(-np.sort(-rare, axis=1), axis=1)], axis=1)
    return sum((total[:, h + m] - total[:, h] >= least).astype(np.int64) for h in range(k2 + 1))


def _common_places(elements: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which elements aren't common, their places in common)."""
    if not len(common):
        return np.ones(len(elements), bool), np.zeros(len(elements), np.int64)
    if common.dtype.itemsize == 4:  # the first 32 bits of elements
        elements = (elements >> np.uint64(32)).astype(np.uint32)
    found = np.minimum(np.searchsorted(common, elements), len(common) - 1)
    return common[found] != elements, found


class Signed(NamedTuple):
    """Signatures: hash, number of the signer, band and group; signers (a set under one band): number of the set, step, slack."""

    sig: np.ndarray
    who: np.ndarray
    band: np.ndarray
    group: np.ndarray
    of: np.ndarray
    step: np.ndarray
    slack: np.ndarray  # a signer with fewer crowded signatures than this shares another with every similar set


def signatures(elements: np.ndarray, at: np.ndarray, common: np.ndarray, percent: int, level: int = 0, rank: np.ndarray | None = None) -> Signed:
    """All signatures of the sets (elements end to end, and n + 1 offsets) in a round: a shape of SHAPES, or prefixes (LAST).

    common: sorted; rank: the place of each of its elements from the rarest on (in order of hash, if not given)."""
    sizes = np.diff(at)
    full = np.flatnonzero(sizes > 0)
    rare, place = _common_places(elements, common)
    if level == LAST:
        rows, length = [np.zeros(0, np.int64)], sizes[full] - (sizes[full] * percent + 99) // 100 + 1
        for k, m in zip(full.tolist(), length.tolist()):
            own = np.arange(at[k], at[k + 1])
            if not rare[at[k] : at[k + 1]].all():
                own = own[np.argsort(np.where(rare[own], -1, place[own] if rank is None else rank[place[own]]), kind="stable")]
            rows.append(own[:m])
        sig = vec.mix(elements[np.concatenate(rows)] ^ np.uint64(0x50F1C5))
        none = np.zeros(len(sig), np.int64)
        return Signed(sig, np.repeat(np.arange(len(full)), length), none, none, full, np.zeros(len(full), np.int64), np.full(len(full), 1 << 14))
    _, n2, k2, least = SHAPES[level]
    subsets = list(combinations(range(n2), n2 - k2))
    low = bands(percent)
    n1 = groups_of(low, level)
    own_band = np.searchsorted(low, sizes[full], side="right") - 1
    mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(vec.mix(elements))])
    rares = np.concatenate([[0], np.cumsum(rare)])
    first = np.concatenate([[0], np.cumsum(sizes[full])])
    rows = np.arange(first[-1]) + np.repeat(at[full] - first[:-1], sizes[full])
    high = elements[rows] >> np.uint64(32)
    who = np.repeat(np.arange(len(full)), sizes[full])
    out: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], *([np.zeros(0, np.int64)] for _ in range(3))]
    slack = np.zeros((2, len(full)), np.int64)
    for step in (0, 1):
        tag = own_band + step
        parts = n1[tag] * n2
        base = np.concatenate([[0], np.cumsum(parts)])
        part = ((high * parts[who].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        counts = np.bincount(base[who] + part, minlength=base[-1])
        # a part's elements are a run of its set's: they are sorted by hash, as the parts are
        stop = np.cumsum(counts) + np.repeat(at[full] - first[:-1], parts)
        some = (rares[stop] - rares[stop - counts]).reshape(-1, n2)
        table = vec.mix((mixed[stop] - mixed[stop - counts]).reshape(-1, n2) + np.arange(n2, dtype=np.uint64) * np.uint64(vec.BASE))
        owner = np.repeat(np.arange(len(full)), n1[tag])
        group = np.arange(len(owner)) - base[owner] // n2
        salt = vec.mix(tag[owner].astype(np.uint64) << np.uint64(32) | group.astype(np.uint64) << np.uint64(2) | np.uint64(level))
        size = sizes[full]
        partner = size * 100 // percent
        if not step:
            partner = np.minimum(partner, low[tag + 1] - 1)
        slack[step] = np.bincount(owner, guards(some, k2, least), len(full)) - (size + partner) * (100 - percent) // (100 + percent)
        for q, subset in enumerate(subsets):
            has = np.flatnonzero(some[:, subset].sum(1) >= least)
            out[0].append(vec.mix(table[has][:, subset].sum(1, dtype=np.uint64) + salt[has] + np.uint64(q + 1)))
            out[1].append(owner[has] + step * len(full))
            out[2].append(tag[owner[has]])
            out[3].append(group[has])
    return Signed(*map(np.concatenate, out), np.tile(full, 2), np.repeat([0, 1], len(full)), slack.ravel())


class Routes:
    """Buckets of signatures: bands with more signatures are cut into more places, by ranges of groups and, beyond these, by hash."""

    def __init__(self, sets: dict[int, int], percent: int, level: int, least: int, bucket_bytes: int = 16 << 20):
        """sets: how many sets each band has."""
        n1 = groups_of(bands(percent), level) if level < LAST else np.ones(len(bands(percent)), np.int64)
        load = np.zeros(len(n1))
        for band, n in sets.items():
            for step in (0, 1):
                load[min(band + step, len(n1) - 1)] += n * n1[min(band + step, len(n1) - 1)]
        each = 6 * len(list(combinations(range(SHAPES[level][1]), SHAPES[level][2]))) if level < LAST else 600
        self.level = level
        self.buckets = max(least, int(-(-load.sum() * each // bucket_bytes)))
        want = np.ceil(PLACES * self.buckets * load / max(load.sum(), 1)).astype(np.int64)
        self.range = np.maximum(1, n1 // np.maximum(want, 1))
        ranges = -(-n1 // self.range)
        self.fine = np.maximum(1, -(-want // ranges))
        self.first = np.concatenate([[0], np.cumsum(ranges * self.fine)])[:-1]

    def bucket(self, signed: Signed) -> np.ndarray:
        if self.level == LAST:
            return (vec.mix(signed.sig ^ np.uint64(77)) % np.uint64(self.buckets)).astype(np.int32)
        t = signed.band
        return ((self.first[t] + signed.group // self.range[t] * self.fine[t] + ((signed.sig >> np.uint64(32)) % self.fine[t].astype(np.uint64)).astype(np.int64)) % self.buckets).astype(np.int32)


def pack_blocks(signed: Signed, cls: np.ndarray, sizes: np.ndarray, routes: Routes) -> tuple[list[int], list[bytes]]:
    """(buckets, blocks) of a part of the rows. A block has 8 bytes, the name of the part (of its signers, 65536 at most, and their
    order), then 32 bits of each signature and 16 of its signer's place in the part, as differences, low bytes first. A signer's
    class (and, as its lowest bit, the step), size and slack go once, to a bucket beyond those of signatures (`signer_rows`)."""
    names = (cls[signed.of] | signed.step).astype("<i8")
    slack, sizes = np.clip(signed.slack, -(2**15), 2**15 - 1).astype("<i2"), sizes[signed.of].astype("<u4")
    numbers, blocks, parts = [], [], []
    for k in range(0, len(names), 65536):
        some = slice(k, k + 65536)
        at = np.arange(len(names[some]), dtype=np.uint64)
        part = vec.mix(vec.mix(names[some].view(np.uint64) + at * np.uint64(vec.BASE)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(at)))
        parts.append((part & ~np.uint64(0xFFFF)).astype("<u8").tobytes())
        numbers.append(routes.buckets + int(part[0] >> np.uint64(16)) % routes.buckets)
        blocks.append(b"".join([parts[-1], names[some].tobytes(), sizes[some].tobytes(), slack[some].tobytes()]))
    key = routes.bucket(signed).astype(np.int64) * max(1, len(parts)) + (signed.who >> 16)
    order = np.lexsort([signed.who, key])
    edge = np.flatnonzero(np.diff(key[order], prepend=-1, append=-1)).tolist()
    for lo, hi in zip(edge[:-1], edge[1:]):
        bucket, part = divmod(int(key[order[lo]]), len(parts))
        for k in range(lo, hi, 1 << 20):
            some = order[k : min(k + (1 << 20), hi)]
            places = np.diff(signed.who[some] & 0xFFFF, prepend=0).astype("<u2").view("u1").reshape(-1, 2).T
            numbers.append(bucket)
            blocks.append(b"".join([parts[part], (signed.sig[some] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), places.tobytes()]))
    return numbers, blocks


def signer_rows(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, classes, sizes, slacks) of the signers of blocks beyond those of signatures."""
    out: list[list[np.ndarray]] = [[] for _ in range(4)]
    for block in blocks:
        c = (len(block) - 8) // 14
        number = np.frombuffer(block, "<u8", 1) | np.arange(c, dtype=np.uint64)
        for held, x in zip(out, (number.view(np.int64), np.frombuffer(block, "<i8", c, 8) & ~1, np.frombuffer(block, "<u4", c, 8 + 8 * c), np.frombuffer(block, "<i2", c, 8 + 12 * c))):
            held.append(x.astype(np.int64))
    return tuple(map(np.concatenate, out))


def candidates(blocks: list[bytes], crowd: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, names, hot) of packed blocks, signers as numbers: distinct pairs that share a signature; and signers with signatures
    in more than `crowd` sets, and how many."""
    each = [(len(block) - 8) // 6 for block in blocks]
    numbers, refs = [np.zeros(0, np.uint64)], []
    packed = np.empty(sum(each), np.uint64)
    done = n = 0
    for block, m in zip(blocks, each):
        place = np.cumsum(np.ascontiguousarray(np.frombuffer(block, "u1", 2 * m, 8 + 4 * m).reshape(2, -1).T).view("<u2").ravel(), dtype=np.uint64)
        new = np.concatenate([[True], place[1:] != place[:-1]])
        numbers.append(np.frombuffer(block, "<u8", 1) | place[new])
        part = packed[done : done + m]
        part[:] = np.frombuffer(block, "<u4", m, 8)
        part <<= np.uint64(32)
        part |= (np.cumsum(new) + (n - 1)).astype(np.uint64)
        refs.append((done, done + m))
        done, n = done + m, n + len(numbers[-1])
    names = np.concatenate(numbers).view(np.int64)
    if len({block[:8] for block in blocks}) < len(blocks):  # a part's block was cut
        names, inverse = np.unique(names, return_inverse=True)
        inverse = inverse.astype(np.uint64)
        for lo, hi in refs:
            part = packed[lo:hi]
            part[:] = part >> np.uint64(32) << np.uint64(32) | inverse[(part & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    packed.sort()
    if len(packed):
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    sig, who = (packed >> np.uint64(32)).astype(np.uint32), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    del packed, numbers
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([start, [len(sig)]]))
    hot = np.zeros(len(names), np.int64)
    if crowd is not None:
        hot = np.bincount(who[np.repeat(count > crowd, count)], minlength=len(names))
        start, count = start[count <= crowd], count[count <= crowd]
    start, count = start[count > 1], count[count > 1]
    if len(start):  # signatures of the same sets make the same pairs
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(vec.mix(who.astype(np.uint64) + np.uint64(vec.BASE)))])
        keep = np.unique(total[start + count] - total[start], return_index=True)[1]
        start, count = start[keep], count[keep]
    found: list[np.ndarray] = []
    held = 0

    def add(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal found, held
        code = np.unique(a << 32 | b)
        found.append(code)
        held += len(code)
        if held > 500_000:
            found = [np.unique(np.concatenate(found))]
            held = len(found[0]) // 2

    for m in np.unique(count).tolist():
        rows = start[count == m]
        if m <= 64:
            i, j = np.triu_indices(m, 1)
            step = max(1, 200_000 // len(i))
            for k in range(0, len(rows), step):
                block = who[rows[k : k + step, None] + np.arange(m)]
                add(block[:, i].ravel(), block[:, j].ravel())
        else:
            for r in rows.tolist():
                own = who[r : r + m]
                for k in range(0, m - 1, max(1, 200_000 // m)):
                    left = np.arange(k, min(m - 1, k + max(1, 200_000 // m)))
                    times = m - 1 - left
                    a = np.repeat(left, times)
                    b = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times) + a + 1
                    add(own[a], own[b])
    code = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    told = np.flatnonzero(hot)
    a, b = names[code >> 32], names[code & 0xFFFFFFFF]
    return np.minimum(a, b), np.maximum(a, b), names[told], hot[told]


def sketch(own: np.ndarray) -> bytes:
    """Parities of the elements by their lowest bits, 2 bits or more an element; two sketches differ in no more bits than the sets in elements."""
    m = max(64, 1 << int(2 * len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1, bitorder="little").tobytes()


def may_be_similar(a: bytes, b: bytes, n: int, m: int, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) * (100 + percent) <= (100 - percent) * (n + m)


def common_elements(texts: DataFrame, n: int, often: int, most: int = 1_000_000, held: int = 4 << 20) -> np.ndarray:
    """The sorted first 32 bits of elements that are in `often` sets or more of all rows (elements alike in these bits count as
    one), `most` of them at most, the most frequent of each slice of hashes; they steer the work only."""
    slices = 2 * max(16, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut() -> pa.RecordBatch:
            high = np.sort(np.concatenate(parts))
            edge = np.searchsorted(high.astype(np.uint64) * np.uint64(slices) >> np.uint64(32), np.arange(1, slices, dtype=np.uint64))
            # differences, low halves first: the high halves are nearly all 0 and compress to nothing
            blocks = [np.diff(x, prepend=x[:1] * 0).astype("<u4").view("<u2").reshape(-1, 2).T.tobytes() for x in np.split(high, edge)]
            some = [k for k, x in enumerate(blocks) if x]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blocks[k] for k in some], pa.binary())], names=["slice", "block"])

        parts: list[np.ndarray] = []
        for batch in batches:
            for part in chunks(batch):
                parts.append((sets_of(part["text"], n)[0] >> np.uint64(32)).astype("<u4"))
                if sum(map(len, parts)) > held:
                    yield cut()
                    parts = []
        if parts:
            yield cut()

    def tally(table: pa.Table) -> pa.Table:
        whole = lambda b: np.cumsum(np.ascontiguousarray(np.frombuffer(b, "<u2").reshape(2, -1).T).view("<u4").ravel(), dtype=np.uint32)
        elements, counts = np.unique(np.concatenate([whole(b) for b in table["block"].to_pylist()]), return_counts=True)
        top = np.flatnonzero(counts >= often)
        top = top[np.argsort(-counts[top], kind="stable")[: max(1, most // slices)]]
        return pa.table({"block": pa.array([elements[top].tobytes()], pa.binary())})

    found = texts.mapInArrow(read, "slice int, block binary").groupBy("slice").applyInArrow(tally, "block binary").collect()  # `most` numbers in all
    return np.sort(np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(r.block, "<u4") for r in found)]))


def known(rows: DataFrame, *columns: str) -> DataFrame:
    """rows, none of which may lack one of columns: a part is named by its rows and their order, so if a lost task ran again with
    rows in another order, numbers of signers could name nothing; that fails, and loses no pair."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if any(batch[c].null_count for c in columns):
                raise RuntimeError("a number of no signer: the rows of docs came in another order when a task ran again")
            yield batch

    return rows.mapInArrow(check, rows.schema)


def first_copies(members: DataFrame, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(classes of several rows, sorted, and the lowest id of each): `most` at most, those of the most rows; they steer the work only."""
    several = written(members.where("n > 0").groupBy("cls").agg(F.count("*").alias("m"), F.min("id").alias("id")).where("m > 1"), "copied")
    held, least = 0, None
    for m, k in sorted(map(tuple, several.groupBy("m").count().collect()), reverse=True):  # fewer than the root of twice the rows
        held += k
        if held > most:
            break
        least = m
    found = several.where(F.col("m") >= (least or 1 << 62)).select("cls", "id").toArrow().sort_by("cls")
    return found["cls"].to_numpy(), found["id"].to_numpy()


def shared_counts(rows: tuple[np.ndarray, np.ndarray], columns: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many elements each set of rows shares with each of columns (elements of a set distinct, end to end, and offsets):
    elements that many have by matrix products, others pair by pair."""
    (x, at), (y, to) = rows, columns
    r, c = len(at) - 1, len(to) - 1
    both = np.zeros((r, c), np.float32)
    names = np.intersect1d(x, y)
    if not len(names):
        return both

    def placed(elements: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(names, elements), len(names) - 1)
        has = np.flatnonzero(names[place] == elements)
        has = has[np.argsort(place[has], kind="stable")]
        start = np.searchsorted(place[has], np.arange(len(names) + 1))
        return np.repeat(np.arange(r if offsets is at else c), np.diff(offsets))[has], place[has], start

    own, e, start = placed(x, at)
    other, f, first = placed(y, to)
    n, m = np.diff(start), np.diff(first)
    heavy = np.flatnonzero(n * m * 150 > r * c)
    for k in range(0, len(heavy), 1024):
        some = heavy[k : k + 1024]
        column = np.full(len(names), -1)
        column[some] = np.arange(len(some))
        left, right = np.zeros((r, len(some)), np.float32), np.zeros((c, len(some)), np.float32)
        i, j = column[e] >= 0, column[f] >= 0
        left[own[i], column[e[i]]] = 1
        right[other[j], column[f[j]]] = 1
        both += left @ right.T
    light = np.ones(len(names), bool)
    light[heavy] = False
    own, e = own[light[e]], e[light[e]]
    done = np.concatenate([[0], np.cumsum(m[e])])
    k = 0
    while k < len(e):
        stop = max(k + 1, int(np.searchsorted(done, done[k] + 4_000_000, side="right")) - 1)
        times = m[e[k:stop]]
        b = other[np.arange(times.sum()) + np.repeat(first[e[k:stop]] - (done[k:stop] - done[k]), times)]
        code = np.repeat(own[k:stop], times) * c + b
        if len(code) * 8 > r * c:
            both += np.bincount(code, minlength=r * c).reshape(r, c)
        else:
            np.add.at(both.reshape(-1), code, 1)
        k = stop
    return both


def forest(link: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, one name of their component) of all rows and columns (a class may be both) that a link touches."""
    label = columns.copy()
    heads = rows.copy()
    for k in np.flatnonzero(link.any(1)).tolist():
        old = np.unique(np.append(label[link[k]], heads[k]))
        if old[0] != old[-1]:
            for held in (label, heads):
                held[np.isin(held, old)] = old[0]
    i, j = link.any(1), link.any(0)
    return np.concatenate([rows[i], columns[j]]), np.concatenate([heads[i], label[j]])


def link_cells(table: pa.Table, percent: int) -> pa.Table:
    """Cells (home, j, c) of rows (side 0) and columns (side 1): the links of each row (rows of the other classes), and a forest."""
    cell = [table[x].to_numpy() for x in ("side", "c", "j", "home")]
    order = np.lexsort(cell)
    side, c, j, home = (x[order] for x in cell)
    cls, n, m = (table[x].to_numpy()[order] for x in ("cls", "n", "m"))
    own = table["own"].combine_chunks()
    own = pa.concat_arrays(own.chunks) if isinstance(own, pa.ChunkedArray) else own
    values, offsets = own.values.to_numpy(), own.offsets.to_numpy()
    pick = lambda rows: (np.concatenate([values[offsets[k] : offsets[k + 1]] for k in rows.tolist()]), np.concatenate([[0], np.cumsum(offsets[rows + 1] - offsets[rows])]))
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
    new = np.flatnonzero(np.concatenate([[True], (home[1:] != home[:-1]) | (j[1:] != j[:-1]) | (c[1:] != c[:-1])]))
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(cls)]):
        at = a + int(np.searchsorted(side[a:b], 1))
        if at in (a, b) or b - at == 1 and at - a == 1 and cls[a] == cls[at]:
            continue
        both = shared_counts(pick(order[a:at]), pick(order[at:b])).astype(np.int64)
        link = both * (100 + percent) >= percent * (n[a:at, None] + n[None, at:b])
        link &= cls[a:at, None] != cls[None, at:b]
        for held, x in zip(out, (cls[a:at], (link * m[None, at:b]).sum(1), *forest(link, cls[a:at], cls[at:b]))):
            held.append(x)
    named, others, node, root = map(np.concatenate, out)
    none = lambda x: pa.nulls(len(x), pa.int64())
    both = [pa.chunked_array([x, y]) for x, y in ((pa.array(named), pa.array(node)), (pa.array(others), none(node)), (none(named), pa.array(root)))]
    return pa.table(dict(zip(("cls", "others", "root"), both)))


def crowded(stake: DataFrame, percent: int, block: int = 2048) -> DataFrame:
    """Of sets (cls, n, m: rows of the class, own: elements): cls and others, the rows of other classes that are similar, in parts
    to be summed; and cls and root, links enough to reach what all links reach."""
    spark = stake.sparkSession
    holders = stake.select("cls", F.explode("own").alias("e")).groupBy("e").agg(F.collect_list("cls").alias("who")).where(F.size("who") > 1)
    shared = holders.select("e", F.size("who").alias("df"), F.explode("who").alias("cls")).groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("s"))
    # elements that no other set has come first in the order; what is left of the prefix are the first of the others
    sets = shared.join(stake.select("cls", "n", "m"), "cls").withColumn("k", F.size("s") - F.expr(f"cast((n * {percent} + 99) div 100 as int)") + 1).where("k > 0")
    sets = sets.withColumn("prefix", F.expr("slice(s, 1, k)"))
    sets = written(sets.select("cls", "n", "m", F.expr("transform(s, x -> x.e)").alias("own"), F.expr("transform(prefix, x -> x.e)").alias("prefix"), F.expr("filter(prefix, x -> 2 * x.df >= element_at(prefix, -1).df)[0].e").alias("home")), "sets")
    meet = sets.select("home", "cls", F.explode("prefix").alias("e")).groupBy("e").agg(F.collect_set("home").alias("homes"), F.collect_list(F.struct("home", "cls")).alias("who")).where("size(homes) > 1")
    away = written(meet.select(F.explode("homes").alias("home"), "who").select("home", F.explode(F.expr("filter(who, x -> x.home != home)")).alias("x")).select("home", F.col("x.home").alias("other"), "x.cls").distinct(), "away")
    # a home moves in with the largest that it meets, twice: a crowd's sets travel to few homes then
    members = sets.groupBy("home").agg(F.count("*").alias("size"))
    met = away.select("home", "other").distinct().join(members.withColumnRenamed("home", "other"), "other").groupBy("home").agg(F.max(F.struct("size", "other")).alias("x"))
    move = written(members.join(met, "home", "left").select("home", F.when(F.struct("size", "home") < F.col("x"), F.col("x.other")).otherwise(F.col("home")).alias("to")), "move")
    move = written(move.join(move.select(F.col("home").alias("to"), F.col("to").alias("last")), "to").select("home", F.col("last").alias("to")), "move")
    columns = away.select("home", "cls").unionByName(sets.select("home", "cls")).join(move, "home").select(F.col("to").alias("home"), "cls")
    columns = written(columns.distinct(), "columns")
    sets = sets.join(move, "home").select("cls", "n", "m", "own", F.col("to").alias("home"))
    sizes = columns.groupBy("home").agg(F.ceil(F.count("*") / block).cast("int").alias("wide")).join(sets.groupBy("home").agg(F.ceil(F.count("*") / block).cast("int").alias("cuts")), "home")
    place, every = lambda cuts: F.pmod(F.xxhash64("cls"), F.col(cuts)).cast("int"), lambda cuts: F.explode(F.sequence(F.lit(0), F.col(cuts) - 1))
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), columns.count() // 4000)
    down = sets.join(sizes, "home").select("home", place("cuts").alias("j"), every("wide").alias("c"), F.lit(0).alias("side"), "cls")
    across = columns.join(sizes, "home").select("home", every("cuts").alias("j"), place("wide").alias("c"), F.lit(1).alias("side"), "cls")
    cells = down.unionByName(across).join(sets.select("cls", "n", "m", "own"), "cls").withColumn("bucket", F.pmod(F.xxhash64("home", "j", "c"), F.lit(buckets)))
    return written(cells.groupBy("bucket").applyInArrow(lambda t: link_cells(t, percent), "cls long, others long, root long"), "crowded")


def similar_classes(docs: DataFrame, percent: int = 70, n: int = 3, often: int = 16, crowd: int = 48, block: int = 2048, block_pairs: int = 20_000, broadcast_ids: int = 1_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, links, crowds): members has id (doc_id, null as the lowest long), cls and n of every row; links has a < b, the
    classes of different sets whose similarity is at least percent / 100, but for links of two sets that have too much in common
    with too many: crowds has these (see `crowded`)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    common = spark.sparkContext.broadcast(common_elements(texts, n, often))  # bounded by `most`
    least_buckets = 2 * max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    low = bands(percent)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                elements, at = sets_of(part["text"], n)
                cls = class_keys(elements, at)
                sketches = [sketch(elements[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                band = np.searchsorted(low, np.diff(at), side="right") - 1
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(cls), pa.array(np.diff(at)), pa.array(band, pa.int32()), pa.array(sketches, pa.binary())], names=["id", "cls", "n", "band", "sketch"])

    members = written(texts.mapInArrow(describe, "id long, cls long, n long, band int, sketch binary"), "members")
    copied = spark.sparkContext.broadcast(first_copies(members))  # bounded by `most`

    def signer(level: int, routes: Routes):
        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()  # classes of this task: their copies add nothing
            for batch in batches:
                for part in chunks(batch, "text", 2 << 20):
                    found = [sets_of(x["text"], n) for x in chunks(part, "text", 1 << 20)]
                    elements = np.concatenate([x[0] for x in found])
                    sizes = np.concatenate([np.diff(x[1]) for x in found])
                    at = np.concatenate([[0], np.cumsum(sizes)])
                    names, ids = class_keys(elements, at), part["id"].to_numpy(zero_copy_only=False)
                    place = np.minimum(np.searchsorted(copied.value[0], names), len(copied.value[0]) - 1)
                    own = np.flatnonzero((copied.value[0][place] != names) | (copied.value[1][place] == ids)) if len(copied.value[0]) else np.arange(len(names))
                    cls, first = np.unique(names[own], return_index=True)
                    first = own[first]
                    new = np.array([c not in seen for c in cls.tolist()], bool) & (sizes[first] > 0)
                    seen.update(cls.tolist())
                    cls, first = cls[new], first[new]
                    rows = np.arange(sizes[first].sum()) + np.repeat(at[first] - np.concatenate([[0], np.cumsum(sizes[first])])[:-1], sizes[first])
                    elements, sizes = elements[rows], sizes[first]
                    signed = signatures(elements, np.concatenate([[0], np.cumsum(sizes)]), common.value, percent, level)
                    numbers, blocks = pack_blocks(signed, cls, sizes, routes)
                    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

        return sign

    def meeter(buckets: int):
        def meet(table: pa.Table) -> pa.Table:
            blocks = table["block"].to_pylist()
            if table["bucket"][0].as_py() >= buckets:
                a, cls, size, slack = signer_rows(blocks)
                none = pa.nulls(len(a), pa.int64())
                return pa.table({"a": a, "b": none, "hot": none, "cls": cls, "n": size, "slack": slack})
            a, b, names, hot = candidates(blocks, crowd)
            none = pa.nulls(len(a) + len(names), pa.int64())
            told = [pa.chunked_array([x, y]) for x, y in ((pa.array(a), pa.array(names)), (pa.array(b), none[: len(names)]), (none[: len(a)], pa.array(hot)))]
            return pa.table(dict(zip(("a", "b", "hot", "cls", "n", "slack"), (*told, none, none, none))))

        return meet

    rows, at_stake, pairs = texts, members, None
    for level in range(LAST):
        routes = Routes({r.band: r["count"] for r in at_stake.where("n > 0").groupBy("band").count().collect()}, percent, level, least_buckets)  # a row a band
        met = written(rows.mapInArrow(signer(level, routes), "bucket int, block binary").groupBy("bucket").applyInArrow(meeter(routes.buckets), "a long, b long, hot long, cls long, n long, slack long"), f"round{level}")
        signers = met.where("cls is not null")
        one, other = signers.select("a", F.col("cls").alias("x"), F.col("n").alias("p")), signers.select(F.col("a").alias("b"), F.col("cls").alias("y"), F.col("n").alias("q"))
        found = met.where("b is not null").select("a", "b").distinct().join(one, "a", "left").join(other, "b", "left")
        found = known(found, "x", "y").where(f"x != y and least(p, q) * 100 >= {percent} * greatest(p, q)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        pairs = found if pairs is None else pairs.unionByName(found)
        hot = met.where("hot is not null").groupBy("a").agg(F.sum("hot").alias("total"))
        short = known(signers.select("a", "cls", "slack").join(hot, "a", "full"), "cls").where("coalesce(total, 0) >= slack")
        at_stake = written(members.join(short.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("band").alias("band"), F.count("*").alias("m")), "short")
        left = at_stake.count()
        ids = at_stake.select("id").distinct()
        # 8 bytes each; beyond, a shuffled join, in an order that a second run of a task has too: parts are named by it
        rows = texts.join(F.broadcast(ids), "id", "left_semi") if left <= broadcast_ids else texts.join(ids, "id", "left_semi").sortWithinPartitions("id", "text")
        if not left:
            break

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                elements, at = sets_of(part["text"], n)
                yield pa.RecordBatch.from_arrays([pa.array(class_keys(elements, at)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(elements.view(np.int64)))], names=["cls", "own"])

    late = at_stake.select("cls", "n", "m")
    if left:
        held = rows.select("text").mapInArrow(gather, "cls long, own array<long>").join(late, "cls")  # a doc_id may have other texts too
        crowds = crowded(held.groupBy("cls").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.first("own").alias("own")), percent, block)
    else:
        crowds = spark.createDataFrame([], "cls long, others long, root long")
    pairs = pairs.distinct()
    classes = members.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    late = late.select("cls", F.lit(True).alias("late"))
    classes = classes.join(F.broadcast(late) if left <= broadcast_ids else late, "cls", "left").withColumn("late", F.coalesce("late", F.lit(False)))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [may_be_similar(x, y, p, q, percent) for x, y, p, q in zip(*(batch[c].to_pylist() for c in ("x", "y", "p", "q")))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = classes.select(F.col("cls").alias("a"), F.col("n").alias("p"), F.col("sketch").alias("x"), F.col("late").alias("s"))
    right = classes.select(F.col("cls").alias("b"), F.col("n").alias("q"), F.col("sketch").alias("y"), F.col("late").alias("t"))
    close = written(pairs.join(left, "a").join(right, "b").where("not (s and t)").select("a", "b", "p", "q", "x", "y").mapInArrow(screen, "a long, b long"), "close")

    # Each pair goes to the group of the smallest class next to it; groups of many pairs are cut into blocks.
    ends = close.select("a", "b").union(close.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nearest = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("g"))
    routed = close.join(nearest, "a").join(nearest.select(F.col("a").alias("b"), F.col("g").alias("h")), "b").select("a", "b", F.least("g", "h").alias("g"))
    load = routed.groupBy("g").agg(F.ceil(F.sqrt(F.count("*") / block_pairs)).cast("int").alias("cuts"))
    cut = lambda c: F.pmod(F.xxhash64(c), F.col("cuts"))
    routed = written(routed.join(load, "g").select("a", "b", F.xxhash64("g", cut("a"), cut("b")).alias("g")), "routed")
    needed = routed.select("g", F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = written(members.join(needed.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("id").alias("id")).select("id").distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= broadcast_ids else wanted  # 8 bytes each; beyond, a shuffled join

    sets = texts.join(wanted, "id", "left_semi").select("text").mapInArrow(gather, "cls long, own array<long>").join(needed.withColumnRenamed("g", "h"), "cls").select("h", "cls", "own")

    def compare(some: pa.Table, own: pa.Table) -> pa.Table:
        held = dict(zip(own["cls"].to_pylist(), (x.values.to_numpy().view(np.uint64) for x in own["own"])))
        a, b = [], []
        for x, y in zip(some["a"].to_pylist(), some["b"].to_pylist()):
            p, q = held[x], held[y]
            both = len(np.intersect1d(p, q, assume_unique=True))
            if both * 100 >= percent * (len(p) + len(q) - both):
                a.append(x)
                b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    links = routed.groupBy("g").cogroup(sets.groupBy("h")).applyInArrow(compare, "a long, b long")
    return members, written(links, "links"), crowds


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node of links (a, b), by large-star and small-star steps."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    before = None
    for _ in range(most):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(low, "u")
        small = kept.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before = now
    raise RuntimeError("components did not settle")


def _class_stats(members: DataFrame, links: DataFrame, crowds: DataFrame) -> DataFrame:
    """cls, root, m (rows of the class), low (its smallest doc_id) of every class with words."""
    counts = members.where("n > 0").groupBy("cls").agg(F.count("*").alias("m"), F.min(F.when(F.col("id") != NONE, F.col("id"))).alias("low"))
    links = links.select("a", "b").unionByName(crowds.where("root is not null").select(F.col("cls").alias("a"), F.col("root").alias("b")))
    roots = written(components(links), "roots").withColumnRenamed("node", "cls")
    return counts.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def keep_one(docs: DataFrame, percent: int = 70, n: int = 3, broadcast_ids: int = 1_000_000, **how) -> DataFrame:
    """docs with one row of each group of similar texts: that of the smallest doc_id (null only if no other; of rows alike in
    doc_id and group, one). Texts without words all stay. All columns stay; no other row is touched."""
    members, links, crowds = similar_classes(docs, percent, n, **how)
    placed = _class_stats(members, links, crowds)
    lows = placed.groupBy("root").agg(F.coalesce(F.min("low"), F.lit(NONE)).alias("keeper"))
    verdict = members.select("id", "cls", "n").distinct().join(placed.select("cls", "root").join(lows, "root").drop("low"), "cls", "left")
    verdict = written(verdict.select("id", "cls", "root", ((F.col("n") == 0) | (F.col("id") == F.col("keeper"))).alias("keep")), "verdicts")
    several = written(members.groupBy("id").count().where("count > 1").select("id"), "several")
    gone = written(verdict.where("not keep").select("id").union(several).distinct(), "gone")
    small = lambda t: F.broadcast(t) if t.count() <= broadcast_ids else t  # noqa: E731  8 bytes each; beyond, a shuffled join
    names = docs.columns
    inner = docs.toDF(*[f"c{k}" for k in range(len(names))])
    text = f"c{names.index('text')}"
    inner = inner.withColumn("id", F.coalesce(F.col(f"c{names.index('doc_id')}").cast("long"), F.lit(NONE)))
    plain = inner.join(small(gone), "id", "left_anti").drop("id")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                elements, at = sets_of(part[text], n)
                yield part.append_column("cls", pa.array(class_keys(elements, at)))

    repeated = inner.join(small(several), "id", "left_semi")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in repeated.schema) + ", cls long"
    judged = repeated.mapInArrow(name, schema).join(verdict.where("keep"), ["id", "cls"])
    cared = judged.where("root is null").unionByName(judged.where("root is not null").dropDuplicates(["id", "root"]))
    return plain.unionByName(cared.select(plain.columns)).toDF(*names)


def similar_documents(docs: DataFrame, percent: int = 70, n: int = 3, **how) -> DataFrame:
    """doc_id, n_shingles, n_similar and component_id of every row of docs (doc_id, text).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case; a text of fewer than n words is one shingle; one without words is
    linked with nothing. n_similar counts the other rows linked directly; component_id is the smallest doc_id in reach (a
    null doc_id counts as a row, but never names a component unless all are null). Repeated rows are rows of their own.
    """
    members, links, crowds = similar_classes(docs, percent, n, **how)
    placed = _class_stats(members, links, crowds)
    ends = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ends.join(placed.select(F.col("cls").alias("b"), "m"), "b").select(F.col("a").alias("cls"), F.col("m").alias("others"))
    linked = linked.unionByName(crowds.where("others > 0").select("cls", "others")).groupBy("cls").agg(F.sum("others").alias("others"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    stats = placed.join(lows, "root").join(linked, "cls", "left").select("cls", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"), "component_id")
    rows = members.select("id", "cls", "n").join(stats, "cls", "left")
    doc_id = F.when(F.col("id") != NONE, F.col("id"))
    empty = F.col("n") == 0
    return rows.select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(empty, F.lit(0)).otherwise(F.col("n_similar")).cast("long").alias("n_similar"), F.when(empty, doc_id).otherwise(F.col("component_id")).alias("component_id"))
