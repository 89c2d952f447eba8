"""Line dedup by a log-template tree.

Every line, and every sentence of a line of several, is parsed down a tree of fixed
depth: its number of tokens, its leading token (tokens with digits are the wildcard),
and then the leaf's branches. In a leaf two lines are alike if `SIMILAR` percent of their
positions are equal; the positions where they differ are the template's variable
fields. A template that documents share recurs: its lines and sentences stay in the
document of the lowest doc_id and are dropped from the others. A sentence ends with a
word that ends in . ! or ? (and quotes or brackets after it) or with its line.

Branches split a leaf so that like lines meet and others don't. Lines under `LONG`
tokens, where one field may vary, go to a branch for each field: all the other tokens. Longer
ones go to `PARTS` branches, the tokens of each of as many equal parts of the rest; like lines with one part
unchanged meet there, and are compared position by position with the branch's
templates, kept in order of doc_id: the first line that is like none is a template. (Fields are tokens; lines
over `FIELDS` tokens have as many fields, each some tokens.)

Lines with equal tokens in one chunk of texts are brought together before any shuffle: the one of the lowest doc_id
goes to the tree, and the others recur for certain. So a line that all documents have is a row a chunk. Branches
are streamed from sorted partitions with their templates only in memory. What recurs goes back to the documents by doc_id; documents
that lose nothing aren't shuffled (while the list of the others is short enough for a broadcast).

Defined results: null text stays null; lines are split at \\n, and a blank line or
one under `LEAST` tokens stays; a line that only repeats in its own document (also
over repeated rows of a doc_id) stays; rows with a null doc_id count as one
document, the last. A text whose lines are all dropped is empty; every row stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import vec
from quern.llm.common import chunks, written

SIMILAR, PARTS, LEAST, LONG, FIELDS = 80, 3, 4, 10, 64
LAST = 2**63 - 1
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END = np.zeros(256, bool)
_END[[*b".!?"]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[*b"\"')]}"]] = True
_WILD = np.uint64(0xD1B54A32D192ED03)
_STEP = np.uint64(0x8CB92BA72F3D8DD7)


class Units(NamedTuple):
    """Lines or sentences: names by their tokens (0: under LEAST tokens), tokens, and the bytes of their fields end to end with n + 1 offsets."""

    name: np.ndarray
    tokens: np.ndarray
    fields: np.ndarray
    at: np.ndarray


class Sentences(NamedTuple):
    """The sentences of lines with several: their lines, where they start (the first at its line's start), and their units."""

    lines: np.ndarray
    starts: np.ndarray
    units: Units


def line_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Units, Sentences]:
    """All lines of all texts: starts, ends, the number of the first line of each text (n + 1), their units, and the sentences."""
    feed = np.flatnonzero(data == 10)
    starts = np.concatenate([offsets[:-1], feed + 1])
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, feed, side="right") - 1])
    # a text's first line begins at its offset; a line that begins at the next text's offset (after a last \n) comes before it
    order = np.lexsort([starts, owner])
    starts, owner = starts[order], owner[order]
    first = np.searchsorted(owner, np.arange(len(offsets)))
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    if len(ends):
        last = first[1:] - 1
        ends[last] = offsets[1:]
    word, word_end, h, _ = vec.words(data, offsets, fold=True)
    begin, stop = np.searchsorted(word, starts), np.searchsorted(word, ends)
    total = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    digit = total[word_end] > total[word]
    last = word_end - 1
    for _ in range(3):
        last = np.where((last > word) & _CLOSE[data[last]], last - 1, last)
    line = np.repeat(np.arange(len(starts)), stop - begin)  # the line of each word; words are in order of lines
    fresh = np.ones(len(word), bool)  # words that begin a sentence
    if len(word):
        fresh[1:] = _END[data[last[:-1]]] | (line[1:] != line[:-1])
    at = np.flatnonzero(fresh)
    of = line[at]
    some = np.bincount(of, minlength=len(starts))[of] > 1 if len(of) else np.zeros(0, bool)
    until = np.append(at[1:], len(word))
    sentences = Sentences(of[some], np.where(np.concatenate([[True], of[1:] != of[:-1]])[: len(of)], starts[of], word[at])[some], units_of(h, digit, at[some], until[some]))
    return starts, ends, first, units_of(h, digit, begin, stop), sentences


def units_of(h: np.ndarray, digit: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> Units:
    """The units of words [begin, stop), which are in order and don't overlap. A field has 2 bytes in units under LONG tokens, else 1."""
    n = stop - begin
    name = np.zeros(len(begin), np.uint64)
    rows = np.flatnonzero(n >= LEAST)
    digits = np.concatenate([[0], np.cumsum(digit)])
    fixed = n - (digits[stop] - digits[begin])
    mask = (fixed >= 3) & (2 * fixed >= n)
    unit = np.repeat(np.arange(len(n)), n)
    before = np.cumsum(n) - n
    at = np.arange(len(unit)) - before[unit]
    place = begin[unit] + at
    token = np.where(digit[place] & mask[unit], _WILD, h[place])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(vec.mix(token + at.astype(np.uint64) * _STEP))])
    b, m = before[rows], n[rows]
    name[rows] = vec.mix(sums[b + m] - sums[b] + m.astype(np.uint64) * _STEP) | np.uint64(1)
    count = np.minimum(m, FIELDS)
    own = np.repeat(np.arange(len(rows)), count)
    k = np.arange(len(own)) - (np.cumsum(count) - count)[own]
    value = vec.mix(sums[b[own] + m[own] * (k + 1) // count[own]] - sums[b[own] + m[own] * k // count[own]])
    short = (m < LONG)[own]
    flat = (value & np.uint64(0xFFFF)).astype("<u2").view(np.uint8)
    size = np.zeros(len(n), np.int64)
    size[rows] = count * np.where(m < LONG, 2, 1)
    return Units(name, n, flat[np.stack([np.ones(len(short), bool), short], 1).ravel()], np.concatenate([[0], np.cumsum(size)]))


def branches(tokens: np.ndarray, fields: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """(keys, numbers of their units, fields to compare) of the branches of units with LEAST tokens or more. The fields of a long unit are its
    tokens (8 bits), those of the branch itself first and left out, as they are equal, and their number instead; short units have none."""
    keys, units, rest = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
    count = np.where(tokens < LONG, tokens, np.minimum(tokens, FIELDS))
    for f in np.unique(count).tolist():
        rows = np.flatnonzero(count == f)
        width = 2 if f < LONG else 1
        grid = fields[at[rows][:, None] + np.arange(f * width)]
        value = vec.mix((grid.view("<u2") if width == 2 else grid).astype(np.uint64) + np.arange(f, dtype=np.uint64) * _STEP)
        leaf = value[:, 0] + tokens[rows].astype(np.uint64) * np.uint64(vec.BASE)
        if f < LONG:
            whole = value.sum(1, dtype=np.uint64)
            made = [whole - value[:, k] for k in range(1, f)] if f > LEAST else [whole]  # under five tokens nothing varies
            rest += [None] * (len(made) * len(rows))
        else:
            edge = [1 + (f - 1) * k // PARTS for k in range(PARTS + 1)]
            made = []
            for a, b in zip(edge[:-1], edge[1:]):
                made.append(value[:, a:b].sum(1, dtype=np.uint64))
                other = np.concatenate([np.full((len(rows), 1), b - a + 1, np.uint8), grid[:, 1:a], grid[:, b:]], 1)
                raw, n = other.tobytes(), other.shape[1]
                rest += [raw[k : k + n] for k in range(0, len(raw), n)]
        for k, part in enumerate(made):
            keys.append(vec.mix(leaf ^ vec.mix(part + np.uint64(((k + 1) * int(_WILD)) % 2**64))))
            units.append(rows)
    return np.concatenate(keys), np.concatenate(units), rest


class Templates:
    """The templates of one branch: the lowest document and fields of each, in order."""

    def __init__(self) -> None:
        self.low: list[int] = []
        self.fields: list[np.ndarray] = []

    def place(self, ids: np.ndarray, fields: list[bytes | None]) -> np.ndarray:
        """For each line, in order of documents, the lowest document of the first template like it; a line like none becomes one."""
        out = ids.copy()
        if fields[0] is None:  # all but one field are equal in the whole branch
            self.low = self.low or [int(ids[0])]
            out[:] = self.low[0]
            return out
        grid = np.frombuffer(b"".join(fields), np.uint8).reshape(len(ids), -1) if len({len(x) for x in fields}) == 1 else None
        if grid is None or self.fields and len(self.fields[0]) != grid.shape[1]:  # keys of two leaves that clash
            return out
        known = int(grid[0, 0])
        need = -(-SIMILAR * (known + grid.shape[1] - 1) // 100) - known
        left = np.arange(len(ids))
        k = 0
        while len(left):
            if k == len(self.fields):
                self.low.append(int(ids[left[0]]))
                self.fields.append(grid[left[0]])
            same = (grid[left, 1:] == self.fields[k][1:]).sum(1) >= need
            out[left[same]] = self.low[k]
            left = left[~same]
            k += 1
        return out


def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, name of lines whose template a lower document has, from branch, id, name, surely, fields, sorted by the first three."""
    now, templates = None, Templates()
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids, out = (batch[c].to_numpy(zero_copy_only=False) for c in ("branch", "id", "surely"))
        out = out.copy()
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        stop = np.append(start[1:], len(key))
        some = np.flatnonzero((stop - start > 1) | (stop == len(key)) | (start == 0))  # alone in a branch, a line is like no other
        fields = batch["fields"]
        for a, b in zip(start[some].tolist(), stop[some].tolist()):
            if key[a] != now:
                now, templates = key[a], Templates()
            out[a:b] |= templates.place(ids[a:b], fields.slice(a, b - a).to_pylist()) < ids[a:b]
        out = pa.array(out)
        yield pa.RecordBatch.from_arrays([batch["id"].filter(out), batch["name"].filter(out)], names=["id", "name"])


def dropped_lines(docs: DataFrame) -> DataFrame:
    """id, keys: for each document (id: doc_id, null as the highest long) the names of lines and sentences whose template a lower document has."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                _, _, first, lines, sentences = line_units(*vec.utf8(part["text"]))
                owner = np.repeat(np.arange(part.num_rows), np.diff(first))
                owner = np.concatenate([owner, owner[sentences.lines]])
                name, tokens = np.concatenate([lines.name, sentences.units.name]), np.concatenate([lines.tokens, sentences.units.tokens])
                fields = np.concatenate([lines.fields, sentences.units.fields])
                at = np.concatenate([lines.at[:-1], sentences.units.at[:-1] + lines.at[-1]])
                rows = np.flatnonzero(name)
                ids = part["id"].to_numpy()[owner[rows]]
                order = np.lexsort([ids, name[rows]])
                rows, ids = rows[order], ids[order]
                fresh, again = np.ones(len(rows), bool), np.zeros(len(rows), bool)
                fresh[1:] = name[rows[1:]] != name[rows[:-1]]
                again[1:] = ~fresh[1:] & (ids[1:] != ids[:-1])  # a lower document of the chunk has the line
                sure = rows[again]
                keys, units, rest = branches(tokens[rows[fresh]], fields, at[rows[fresh]])
                units = np.concatenate([np.flatnonzero(fresh)[units], np.flatnonzero(again)])
                keys = np.concatenate([keys, vec.mix(ids[again].view(np.uint64))])
                surely = np.repeat([False, True], [len(rest), len(sure)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(ids[units]), pa.array(name[rows[units]].view(np.int64)), pa.array(surely), pa.array(rest + [None] * len(sure), pa.binary())], names=["branch", "id", "name", "surely", "fields"]
                )

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tree = texts.mapInArrow(read, "branch long, id long, name long, surely boolean, fields binary").repartition("branch").sortWithinPartitions("branch", "id", "name")
    return tree.mapInArrow(grow, "id long, name long").groupBy("id").agg(F.collect_set("name").alias("keys"))


def drop_lines(docs: DataFrame, counts: bool = False, broadcast_ids: int = 1_000_000) -> DataFrame:
    """docs without the lines and sentences of recurring templates; all rows and columns stay (n_chars, where there is one, follows the text).

    counts: adds n_lines and n_dropped (lines of which nothing stays). Other columns keep their names whatever these are.
    """
    names = docs.columns
    inner = docs.toDF(*[f"c{k}" for k in range(len(names))])
    text, key = f"c{names.index('text')}", f"c{names.index('doc_id')}"
    inner = inner.withColumn("at", F.coalesce(F.col(key).cast("long"), F.lit(LAST)))
    dropped = written(dropped_lines(docs).withColumnRenamed("id", "at"), "dropped")
    if dropped.count() <= broadcast_ids:  # 8 bytes each
        ids = F.broadcast(dropped.select("at"))
        joined = inner.join(ids, "at", "left_semi").join(dropped, "at").unionByName(inner.join(ids, "at", "left_anti").withColumn("keys", F.lit(None).cast("array<long>")))
    else:
        joined = inner.join(dropped, "at", "left")
    joined = joined.drop("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                column = part[text]
                data, offsets = vec.utf8(column)
                n_lines = np.ones(part.num_rows, np.int64)
                if len(data):
                    total = np.concatenate([[0], np.cumsum(data == 10)])
                    n_lines += total[offsets[1:]] - total[offsets[:-1]]
                n_dropped = np.zeros(part.num_rows, np.int64)
                rows = np.flatnonzero(part["keys"].is_valid().to_numpy(zero_copy_only=False))
                if len(rows):
                    some = column.take(pa.array(rows))
                    data, offsets = vec.utf8(some)
                    starts, ends, first, lines, sentences = line_units(data, offsets)
                    gone = [set(x) for x in part["keys"].take(pa.array(rows)).to_pylist()]
                    inner_names, inner_starts = sentences.units.name.view(np.int64).tolist(), sentences.starts.tolist()
                    of = np.searchsorted(sentences.lines, np.arange(len(starts) + 1)).tolist()
                    listed, raw, new = lines.name.view(np.int64).tolist(), data.tobytes(), column.to_pylist()
                    for j, row in enumerate(rows.tolist()):
                        here = range(first[j], first[j + 1])
                        kept = []
                        for k in here:
                            if listed[k] in gone[j]:
                                continue
                            own = range(of[k], of[k + 1])
                            stay = [inner_names[x] not in gone[j] for x in own]
                            if all(stay):
                                kept.append(raw[starts[k] : ends[k]])
                            elif any(stay):
                                limits = [*inner_starts[own.start : own.stop], int(ends[k])]
                                line = b"".join(raw[a:z] for a, z, s in zip(limits, limits[1:], stay) if s)
                                kept.append(line if stay[-1] else line.rstrip(b" \t\r\x0b\x0c"))
                        n_dropped[row] = len(here) - len(kept)
                        new[row] = b"\n".join(kept).decode("utf-8", "replace")
                    part = part.set_column(part.schema.get_field_index(text), text, pa.array(new, column.type))
                part = part.drop_columns(["keys"])
                if counts:
                    part = part.append_column("n_lines", pa.array(n_lines)).append_column("n_dropped", pa.array(n_dropped))
                yield part

    kept = joined.drop("keys")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["n_lines long", "n_dropped long"] * counts)
    out = joined.mapInArrow(run, schema)
    if "n_chars" in names:
        at = f"c{names.index('n_chars')}"
        out = out.withColumn(at, F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.toDF(*names, *["n_lines", "n_dropped"] * counts)
