"""Best-fit packing of token pieces into sequences by bin completion, branch and bound.

Lengths are whole numbers up to the capacity, so the problem is its histogram: at
most `capacity` counts, whatever the number of documents. The driver solves the
histogram; its plan is a bounded list of runs "this multiset of lengths, so many
times"; tasks then give each piece its place by its rank among the pieces of its
length. Nothing is collected but the histogram, and no group goes to one task.

Solving (bin completion, Korf 2002): take the largest remaining length, enumerate
its undominated fillings from the least waste on, apply one as often as the counts
allow, and go on; prune when the sequences used so far plus the waste bound
ceil(remaining tokens / capacity) can't beat the incumbent, which starts as
best-fit decreasing. On the way back every node goes on with its next filling, and, where one
was applied several times, with applying it once; so nothing is out of reach.
It stops when the incumbent meets `lower_bound`, when all is tried (then it is optimal),
or after `nodes` branchings (None: no end), with the incumbent: always a whole valid packing.

The path can be thousands of levels deep. It has one histogram, which is changed on the way down and put back on the way up; a level
keeps the filling it tried last, and only the deepest `LIVE` keep the tables of their fillings. Others make them again when the
search is back at them, and go on after that filling.

Defined results: null text is empty and has one piece of its end id (none without an end id); null doc_ids stay
null; repeated rows are documents of their own; texts of any length are cut into pieces; an empty table gives no rows; only doc_id
and text are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import chunks, id_text, written
from quern.llm.wordbpe import encoder

Run = tuple[tuple[int, ...], int]

#: Levels of the search that keep the tables of their fillings (0.3 MB each at a capacity of 2048).
LIVE = 32


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs of best-fit decreasing over a histogram; equal open sequences are handled together."""
    open_bins: Counter[tuple[int, ...]] = Counter()
    gaps: dict[int, list[tuple[int, ...]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            gap = next((g for g in range(length, capacity) if gaps.get(g)), None)
            if gap is None:
                per = capacity // length
                for m, n in ((per, left // per), (left % per, 1)):
                    if m and n:
                        _open(open_bins, gaps, (length,) * m, n, capacity)
                left = 0
                break
            filled = gaps[gap][-1]
            n = open_bins[filled]
            m = min(gap // length, left // n) if left >= n else 1
            n = min(n, left)
            m = max(1, m)
            open_bins[filled] -= n
            if not open_bins[filled]:
                del open_bins[filled]
                gaps[gap].pop()
            _open(open_bins, gaps, filled + (length,) * m, n, capacity)
            left -= n * m
    return list(open_bins.items())


def _open(open_bins: Counter, gaps: dict, filled: tuple[int, ...], n: int, capacity: int) -> None:
    if filled not in open_bins:
        gaps.setdefault(capacity - sum(filled), []).append(filled)
    open_bins[filled] += n


def fillings(counts: dict[int, int], room: int, after: tuple[int, ...] | None = None) -> Iterator[tuple[int, ...]]:
    """The undominated fillings of room from counts, from the least waste on (sums are found by bit sets of what can be reached); with after, one of them, only those behind it."""
    sizes = [s for s in sorted(counts, reverse=True) if s <= room and counts[s]]
    reach = [1]
    full = (1 << (room + 1)) - 1
    for s in reversed(sizes):  # reach[k]: sums that the k smallest sizes make
        now, c, step = reach[-1], min(counts[s], room // s), 1
        while c > 0:
            step = min(step, c)
            now |= now << (s * step) & full
            c, step = c - step, step * 2
        reach.append(now & full)
    reach.reverse()

    def fitting(k: int, m: int, rest: int) -> int:
        """The most pieces of sizes[k], m at most, after which smaller ones can make up rest; -1 if there are none."""
        while m >= 0 and not reach[k + 1] >> (rest - m * sizes[k]) & 1:
            m -= 1
        return m

    def exactly(total: int, last: tuple[int, ...] | None) -> Iterator[tuple[int, ...]]:
        """The fillings of total, those with larger pieces first; a loop, as sizes can be more than calls may be nested."""
        path: list[tuple[int, int, int]] = []  # k, m, rest: m pieces of sizes[k], put where rest was to be filled
        k, rest, used = 0, total, Counter(last)
        for k, s in enumerate(sizes if last else ()):
            if used[s]:
                path.append((k, used[s], rest))
                rest -= used[s] * s
        while True:
            if last is None:
                while rest:
                    m = fitting(k, min(counts[sizes[k]], rest // sizes[k]), rest)
                    if m:
                        path.append((k, m, rest))
                        rest -= m * sizes[k]
                    k += 1
                yield tuple(sizes[k] for k, m, _ in path for _ in range(m))
            last, m = None, -1
            while path and m < 0:
                k, m, rest = path.pop()
                m = fitting(k, m - 1, rest)
            if m < 0:
                return
            if m:
                path.append((k, m, rest))
                rest -= m * sizes[k]
            k += 1

    top = reach[0]
    if after is not None:
        top &= (2 << sum(after)) - 1
    rising = sizes[::-1]
    while top:
        total = top.bit_length() - 1
        top ^= 1 << total
        for filling in exactly(total, after):
            if not dominated(filling, counts, rising, room - total):
                yield filling
        after = None


def dominated(filling: tuple[int, ...], counts: dict[int, int], rising: list[int], waste: int) -> bool:
    """Whether what is left of counts (its sizes: rising) makes the filling better: one more piece, or a larger piece in the place of one or of two."""
    used = Counter(filling)

    def has(low: int, high: int) -> bool:
        for s in rising[bisect_left(rising, low) : bisect_right(rising, high)]:
            if counts[s] > used[s]:
                return True
        return False

    if waste and has(1, waste):
        return True
    if waste and any(has(s + 1, s + waste) for s in used):
        return True
    held = sorted(used)
    return any(has(s + t, s + t + waste) for k, s in enumerate(held) for t in held[k:] if s != t or used[s] > 1)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's bound L2: for every k, pieces over capacity - k are alone, those over half are apart, and pieces from k
    to half fill what these leave."""
    sizes = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in sizes.tolist()], np.int64)
    if not len(sizes):
        return 0
    number, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * sizes)])
    half = np.searchsorted(sizes, capacity // 2, side="right")
    best = 0
    for k in [0, *sizes[:half].tolist()]:
        low, alone = np.searchsorted(sizes, k), max(half, np.searchsorted(sizes, capacity - k, side="right"))
        apart = number[alone] - number[half]
        space = apart * capacity - (tokens[alone] - tokens[half])
        best = max(best, int(number[-1] - number[alone] + apart - min(0, (space - (tokens[half] - tokens[low])) // capacity)))
    return best


class Level:
    """A node on the path of the search: its largest length, the tokens left and the sequences used before its filling; the filling
    last tried (again tells of which round) and how often it is applied now; whether one went several times; its fillings to come."""

    __slots__ = ("large", "tokens", "used", "filling", "times", "several", "again", "more")

    def __init__(self, large: int, tokens: int, used: int):
        self.large, self.tokens, self.used = large, tokens, used
        self.filling: tuple[int, ...] | None = None
        self.times, self.several, self.again = 0, False, False
        self.more: Iterator[tuple[int, ...]] | None = None


def pack(counts: dict[int, int], capacity: int, nodes: int | None = 20_000) -> list[Run]:
    """A packing of the histogram counts (length: number) as runs; as few sequences as the search finds."""
    counts = {k: v for k, v in counts.items() if v}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    bound = lower_bound(counts, capacity)
    best = best_fit_decreasing(counts, capacity)
    fewest = sum(n for _, n in best)
    left = dict(counts)  # by the fillings that the path applies
    path: list[Level] = []

    def enter(tokens: int, used: int) -> None:
        nonlocal best, fewest
        ends: list[Run] = []
        if len(left) == 1 and 2 * max(left) <= capacity:
            ((size, n),) = left.items()
            per = capacity // size
            ends = [((size,) * per, n // per)] * bool(n // per) + [((size,) * (n % per), 1)] * bool(n % per)
            used += -(-n // per)
        elif left:
            if used + -(-tokens // capacity) < fewest:
                path.append(Level(max(left), tokens, used))
                if len(path) > LIVE:
                    path[-LIVE - 1].more = None
            return
        if used < fewest:
            best, fewest = [((x.large, *x.filling), x.times) for x in path] + ends, used

    enter(sum(k * v for k, v in counts.items()), 0)
    while path and fewest > bound:
        level = path[-1]
        large = level.large
        if level.times:  # back from below
            for s, m in Counter((large, *level.filling)).items():
                left[s] = left.get(s, 0) + level.times * m
            level.times = 0
        if level.used + -(-level.tokens // capacity) >= fewest:
            path.pop()
            continue
        if level.more is None:
            level.more = fillings({**left, large: left[large] - 1}, capacity - large, level.filling)
        filling = next(level.more, None)
        if filling is None:
            if level.again or not level.several:
                path.pop()
            else:  # a second round, with those once that went several times
                level.again, level.filling, level.more = True, None, None
            continue
        level.filling = filling
        need = Counter((large, *filling))
        most = min(left[s] // m for s, m in need.items())
        if level.again and most == 1:
            continue
        if nodes is not None:
            nodes -= 1
            if nodes < 0:
                break
        level.several |= most > 1
        level.times = 1 if level.again else most
        for s, m in need.items():
            left[s] -= level.times * m
            if not left[s]:
                del left[s]
        enter(level.tokens - level.times * (large + sum(filling)), level.used + level.times)
    return best


def piece_table(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, with its task and its rank there among pieces of its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in chunks(batch, "text", 1 << 21):
                ids, offsets = enc.encode(part["text"])
                if end_id is not None:
                    ids = np.insert(ids, offsets[1:], end_id)
                    offsets = offsets + np.arange(len(offsets))
                size = np.diff(offsets)
                per = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), per)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                raw = ids.astype("<u4")
                at = offsets[doc] + start
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                first = np.searchsorted(ranked, ranked)
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - first + seen[ranked]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task), pa.int32()), pa.array(rank)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
                )

    return id_text(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 0, capacity: int = 2048, nodes: int | None = 20_000) -> DataFrame:
    """Packs docs (doc_id, text) into sequences of at most capacity tokens.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only documents longer than the capacity
    are cut, into whole capacities and a rest. Null text is empty; repeated rows are documents of their own; a null doc_id
    stays null; with end_id None an empty document has no piece.
    """
    spark = docs.sparkSession
    pieces = written(piece_table(docs, tokenizer, end_id, capacity), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs = pack(histogram, capacity, nodes)

    # A run's slots of one length: ranks [from, to) of that length, `per` to a sequence, from sequence `first` on.
    used: Counter[int] = Counter()
    table: dict[int, list[tuple[int, int, int, tuple[int, ...]]]] = {}
    first = 0
    for filling, n in runs:
        offset, places = 0, {}
        for s in filling:
            places.setdefault(s, []).append(offset)
            offset += s
        for s, at in places.items():
            table.setdefault(s, []).append((used[s], len(at), first, tuple(at)))
            used[s] += n * len(at)
        first += n
    plan = spark.sparkContext.broadcast(table)  # bounded: runs of at most capacity lengths

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy() + batch["before"].to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)]):
                rows = order[a:b]
                s = int(length[rows[0]])
                if s not in made:
                    slots = plan.value[s]
                    flat = np.array([o for x in slots for o in x[3]], np.int64)
                    made[s] = (*(np.array([x[k] for x in slots], np.int64) for k in range(3)), np.cumsum([0] + [x[1] for x in slots]), flat)
                start, per, begin, at, flat = made[s]
                k = np.searchsorted(start, rank[rows], side="right") - 1
                within = rank[rows] - start[k]
                sequence[rows] = begin[k] + within // per[k]
                offset[rows] = flat[at[k] + within % per[k]]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = counts.select("task", "length", (F.sum("n").over(_by_length()) - F.col("n")).alias("before"))
    joined = pieces.join(before, ["task", "length"])
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "before").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _by_length():
    from pyspark.sql import Window

    return Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)
