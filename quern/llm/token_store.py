"""Token-id output: Arrow files of equal-length sequences with masks, read without copying.

A shard is one Arrow IPC file whose record batches hold ``input_ids``, a fixed-size
list of ``length`` ids (16-bit where the vocabulary allows, else 32-bit), and
``mask``, a fixed-size list of ``length / 8`` bytes (one bit an id, lowest first,
0 where the last sequence is padded). All batches but the last have the same number
of sequences, so sequence i is found by arithmetic, and a memory-mapped file gives
it as a numpy view. Beside it, ``*.index.arrow`` has doc_id, start (in the shard)
and n_tokens of each document.

Layout of the work: documents are range-partitioned by doc_id; each task sorts,
encodes and writes its own shard (under a temporary name that is renamed at its
end, so a retried task leaves one whole file); the driver sees one row a shard.

Defined results: null text is empty (only the end id); null doc_id comes first;
repeated rows are documents of their own, in order of text; no rows give no shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import chunks, filesystem, id_text, shared_dir
from quern.llm.wordbpe import encoder

BATCH = 256
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    """Writes one shard; ids may come in any portions."""

    def __init__(self, uri: str, length: int, wide: bool):
        if length % 8:
            raise ValueError("length must be a multiple of 8")
        self.fs, path = filesystem(uri)
        self.final, self.temp = path, f"{path}.{uuid.uuid4().hex}.tmp"
        self.length, self.dtype = length, np.uint32 if wide else np.uint16
        item = pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema([("input_ids", pa.list_(item, length)), ("mask", pa.list_(pa.uint8(), length // 8))])
        self.sink = self.fs.open_output_stream(self.temp)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.rest: list[np.ndarray] = []
        self.held = self.total = 0
        self.index: list[pa.RecordBatch] = []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.index.append(pa.record_batch([doc_ids, pa.array(self.total + offsets[:-1]), pa.array(np.diff(offsets))], schema=INDEX))
        self.rest.append(ids.astype(self.dtype))
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= BATCH * self.length:
            flat, whole = np.concatenate(self.rest), self.held // (BATCH * self.length) * BATCH * self.length
            for a in range(0, whole, BATCH * self.length):
                self._write(flat[a : a + BATCH * self.length])
            self.rest, self.held = [flat[whole:]], self.held - whole

    def _write(self, flat: np.ndarray) -> None:
        n = -(-len(flat) // self.length) * self.length
        ids, mask = np.zeros(n, self.dtype), np.zeros(n, bool)
        ids[: len(flat)], mask[: len(flat)] = flat, True
        bits = np.packbits(mask, bitorder="little")
        self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(bits), self.length // 8)], schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._write(np.concatenate(self.rest))
        self.writer.close()
        self.sink.close()
        with self.fs.open_output_stream(self.temp + ".i") as sink, pa.ipc.new_file(sink, INDEX) as out:
            for batch in self.index:
                out.write_batch(batch)
        self.fs.move(self.temp + ".i", self.final.removesuffix(".arrow") + ".index.arrow")
        self.fs.move(self.temp, self.final)

    def abort(self) -> None:
        self.sink.close()
        self.fs.delete_file(self.temp)


class Shard:
    """Random access to a shard; on a local or mounted path nothing is copied."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        opened = (lambda p: pa.memory_map(p)) if fs.type_name == "local" else fs.open_input_file
        self.reader = pa.ipc.open_file(opened(path))
        self.index = pa.ipc.open_file(opened(path.removesuffix(".arrow") + ".index.arrow")).read_all()
        self.length = self.reader.schema.field("input_ids").type.list_size
        self.batches = self.reader.num_record_batches

    def batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids (sequences x length) and mask bytes (sequences x length / 8) of a record batch, as views."""
        b = self.reader.get_batch(k)
        return b.column(0).flatten().to_numpy().reshape(-1, self.length), b.column(1).flatten().to_numpy().reshape(-1, self.length // 8)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.batch(i // BATCH)
        return ids[i % BATCH], np.unpackbits(mask[i % BATCH], bitorder="little").astype(bool)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start and ids of every document, by the index; masked places are left out."""
        k, flat, base = -1, np.zeros(0, np.uint16), 0
        for chunk in self.index.to_batches():
            for doc_id, start, n in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist(), chunk.column(2).to_pylist()):
                while base + len(flat) < start + n:
                    k += 1
                    ids, mask = self.batch(k)
                    ids = ids.reshape(-1)
                    if k == self.batches - 1:
                        ids = ids[np.unpackbits(mask.reshape(-1), bitorder="little").astype(bool)]
                    flat, base = np.concatenate([flat[start - base :], ids]), start
                yield doc_id, start, flat[start - base : start - base + n]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int | None = 1, length: int = 1024, uri: str | None = None) -> list[tuple[str, int, int]]:
    """Writes the shards of docs (doc_id, text) in ascending doc_id order; returns (uri, ids before it, ids) of each.

    tokenizer: the path of a tokenizers file. end_id: put after each document (None: nothing).
    """
    spark = docs.sparkSession
    uri = uri or shared_dir(spark, "tokens")
    fs, path = filesystem(uri)
    fs.create_dir(path, recursive=True)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        name, enc = f"{uri}/shard-{shard:06d}.arrow", encoder(tokenizer)
        out = None
        try:
            for batch in batches:
                for part in chunks(batch, "text", 1 << 21):
                    out = out or ShardWriter(name, length, enc.vocab > 65536 or (end_id or 0) > 65535)
                    ids, offsets = enc.encode(part["text"])
                    if end_id is not None:
                        ids = np.insert(ids, offsets[1:], end_id)
                        offsets = offsets + np.arange(len(offsets))
                    out.add(part["doc_id"], ids, offsets)
        except BaseException:
            if out:
                out.abort()
            raise
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "uri": [name], "n": [out.total]}, schema=pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("n", pa.int64())]))

    sorted_docs = id_text(docs).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows = sorted(sorted_docs.mapInArrow(write, "shard int, uri string, n long").collect())  # one row a task
    starts = np.concatenate([[0], np.cumsum([r.n for r in rows])]).tolist()
    return [(r.uri, starts[k], r.n) for k, r in enumerate(rows)]


def read_tokens(spark, shards: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (over all shards), n_tokens and ids_crc32 of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch["uri"].to_pylist(), batch["base"].to_pylist()):
                shard, rows = Shard(uri), []
                for doc_id, start, ids in shard.documents():
                    rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 20_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    table = spark.createDataFrame([(u, b) for u, b, _ in shards], "uri string, base long")
    return table.repartition(max(1, len(shards))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
