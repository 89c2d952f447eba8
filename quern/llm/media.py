"""Media columns: audio features of 8-bit samples, stored as fixed-shape Arrow tensors with time spans.

Payloads become WAV files (8-bit unsigned mono) in an Arrow file of the shared
folder; they are read back, resampled by a polyphase filter, turned into overlapped
log-mel filterbanks, and segmented by energy with hysteresis. Features of a whole
clip are a run of equal tensors of shape (frames, mels), the last one padded, in an
Arrow column of the fixed-shape tensor type, each with its time span.

Defined results: null text is an empty payload, which is one block of 64 zero
bytes; equal payloads give equal stored bytes and features; every row gives a row.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quern.llm import vec
from quern.llm.common import chunks, filesystem, id_text, shared_dir

RATE, BLOCK = 16_000, 64
UP, DOWN, TAPS = 3, 4, 8
FRAME, HOP, MELS, PATCH = 512, 256, 16, 16
HIGH, LOW, HOLD = 0.5, 0.25, 2


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A WAV file of 8-bit unsigned mono samples (RIFF pads an odd length)."""
    pad = b"\0" * (len(samples) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + pad


def samples_of(data: bytes) -> tuple[memoryview, int]:
    """The samples and the rate of a WAV file, by its chunks."""
    view = memoryview(data)
    if view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(view):
        kind, size = bytes(view[at : at + 4]), int.from_bytes(view[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            rate = int.from_bytes(view[at + 12 : at + 16], "little")
        elif kind == b"data":
            return view[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


@lru_cache(8)
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc low-pass of 2 * taps * max(up, down) + 1 points, as `up` phases (rows), each summing to 1."""
    half = taps * max(up, down)
    t = np.arange(-half, half + 1)
    h = np.sinc(t / max(up, down)) * np.hamming(2 * half + 1)
    width = -(-len(h) // up)
    h = np.concatenate([h, np.zeros(width * up - len(h))]).reshape(width, up).T
    return (h / h.sum(1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """x at up / down times its rate: output m is one phase of the filter over the inputs around m * down / up."""
    h = _phases(up, down, taps)
    half, width = taps * max(up, down), h.shape[1]
    n = -(-len(x) * up // down)
    m = np.arange(n, dtype=np.int64) * down + half
    phase, last = m % up, m // up
    x = np.concatenate([np.zeros(width, np.float32), x.astype(np.float32), np.zeros(width + half // up + 1, np.float32)])
    out = np.empty(n, np.float32)
    view = np.lib.stride_tricks.sliding_window_view(x, width)
    for p in range(up):
        rows = np.flatnonzero(phase == p)
        if len(rows):  # every step-th output, over inputs an equal way apart
            apart = last[rows[1]] - last[rows[0]] if len(rows) > 1 else 1
            out[rows] = view[last[rows[0]] + 1 :: apart][: len(rows)] @ h[p, ::-1]
    return out


@lru_cache(8)
def _mel(frame: int, mels: int, rate: int) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale: (frame / 2 + 1) x mels."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, frame // 2 + 1)[:, None]
    up, down = (f - points[:-2]) / (points[1:-1] - points[:-2]), (points[2:] - f) / (points[2:] - points[1:-1])
    return np.clip(np.minimum(up, down), 0, None).astype(np.float32)


def log_mel(x: np.ndarray, rate: float, frame: int = FRAME, hop: int = HOP, mels: int = MELS) -> tuple[np.ndarray, np.ndarray]:
    """log-mel energies (frames x mels) and the mean energy of each overlapped frame; the end is padded to a whole frame."""
    n = 1 + max(0, -(-(len(x) - frame) // hop))
    x = np.concatenate([x, np.zeros((n - 1) * hop + frame - len(x), np.float32)])
    window = np.hanning(frame).astype(np.float32)
    out, energy = np.empty((n, mels), np.float32), np.empty(n, np.float32)
    view = np.lib.stride_tricks.sliding_window_view(x, frame)[::hop]
    for a in range(0, n, 2048):
        part = view[a : a + 2048]
        energy[a : a + 2048] = np.einsum("ij,ij->i", part, part) / frame
        spectrum = np.fft.rfft(part * window)
        out[a : a + 2048] = np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ _mel(frame, mels, int(rate)) + np.float32(1e-6))
    return out, energy


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW, hold: int = HOLD) -> list[tuple[int, int]]:
    """Frame spans [a, b): a segment opens where the energy reaches high times its peak, and ends before the first of
    `hold` frames in a row under low times the peak."""
    peak = float(energy.max(initial=0))
    if peak <= 0:
        return []
    loud, quiet = np.flatnonzero(energy >= high * peak), energy < low * peak
    run = np.convolve(quiet, np.ones(hold, int))[hold - 1 :][: len(quiet)] == hold if len(quiet) >= hold else np.zeros(len(quiet), bool)
    stops, out, at = np.flatnonzero(run), [], 0
    while at < len(energy):
        k = np.searchsorted(loud, at)
        if k == len(loud):
            break
        a = int(loud[k])
        k = np.searchsorted(stops, a)
        b = int(stops[k]) if k < len(stops) else len(energy)
        out.append((a, b))
        at = b + 1
    return out


def features(samples: np.ndarray, rate: int = RATE) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """Log-mel frames and loud time spans (seconds) of unsigned 8-bit samples."""
    x = (samples.astype(np.float32) - 128) / 128
    y = resample(x)
    new = rate * UP / DOWN
    mel, energy = log_mel(y, new)
    end = len(y) / new
    return mel, [(a * HOP / new, min(((b - 1) * HOP + FRAME) / new, end)) for a, b in segments(energy)]


def patches(mel: np.ndarray, frames: int = PATCH) -> np.ndarray:
    """mel as equal tensors (n x frames x mels), the last padded by zeros."""
    n = -(-len(mel) // frames)
    out = np.zeros((n * frames, mel.shape[1]), np.float32)
    out[: len(mel)] = mel
    return out.reshape(n, frames, mel.shape[1])


TENSOR = pa.fixed_shape_tensor(pa.float16(), (PATCH, MELS), dim_names=("frame", "mel"))
MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.large_binary())])
FEATURES = pa.schema([("clip", pa.int64()), ("doc_id", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("log_mel", TENSOR)])


class _File:
    """An Arrow file under a temporary name until it is whole."""

    def __init__(self, uri: str, schema: pa.Schema, compression: str | None):
        self.fs, self.path = filesystem(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.sink = self.fs.open_output_stream(self.temp)
        self.writer = pa.ipc.new_file(self.sink, schema, options=pa.ipc.IpcWriteOptions(compression=compression))

    def close(self) -> None:
        self.writer.close()
        self.sink.close()
        self.fs.move(self.temp, self.path)


def _opened(uri: str) -> pa.ipc.RecordBatchFileReader:
    fs, path = filesystem(uri)
    return pa.ipc.open_file(pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path))


def store_media(docs: DataFrame, uri: str) -> list[str]:
    """Writes the payload of every text (its UTF-8 bytes, padded by 0 to a positive multiple of 64) as WAV; returns the files, one a task."""
    fs, path = filesystem(uri)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out = f"{uri}/media-{TaskContext.get().partitionId():06d}.arrow", None
        for batch in batches:
            for part in chunks(batch):
                out = out or _File(name, MEDIA, "zstd")
                data, offsets = vec.utf8(part["text"])
                raw = data.tobytes()
                size = np.diff(offsets)
                clips = [wav(raw[a:b] + b"\0" * (max(BLOCK, -(-(b - a) // BLOCK) * BLOCK) - (b - a))) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                out.writer.write_batch(pa.record_batch([part["doc_id"], pa.array(size, pa.int64()), pa.array(clips, pa.large_binary())], schema=MEDIA))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"uri": [name]})

    return sorted(r.uri for r in id_text(docs).mapInArrow(write, "uri string").collect())  # one row a task


def media_features(spark, files: list[str]) -> DataFrame:
    """Reads media files back, stores their features beside them as tensors with time spans, and returns a row a clip.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (a digest of the stored
    tensors, read back, and of the loud spans), n_frames, n_segments, loud_s.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch["uri"].to_pylist():
                yield from _one_file(uri)

    table = spark.createDataFrame([(f,) for f in files], "uri string").repartitionByRange(max(1, len(files)), "uri")  # a file a task
    return table.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_segments long, loud_s double")


def _one_file(uri: str) -> Iterator[pa.RecordBatch]:
    folder, _, name = uri.rpartition("/")
    media, target = _opened(uri), f"{folder}/{name.replace('media-', 'log-mel-')}"
    out, clip, rows = _File(target, FEATURES, "zstd"), 0, []
    for k in range(media.num_record_batches):
        batch = media.get_batch(k)
        tensors, owner, ids, starts, ends = [], [], [], [], []
        for doc_id, n, data in zip(batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), batch["media"].to_pylist()):
            view, rate = samples_of(data)
            mel, spans = features(np.frombuffer(view, np.uint8), rate)
            cut = patches(mel).astype(np.float16)
            step = HOP * DOWN / (UP * rate)
            tensors.append(cut)
            owner += [clip] * len(cut)
            ids += [doc_id] * len(cut)
            starts += [j * PATCH * step for j in range(len(cut))]
            ends += [min((j + 1) * PATCH, len(mel)) * step for j in range(len(cut))]
            rows.append([doc_id, n, len(view), hashlib.sha256(view).hexdigest(), zlib.crc32(view[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), spans, len(mel)])
            clip += 1
        flat = np.concatenate(tensors)
        column = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(flat.reshape(-1)), PATCH * MELS))
        out.writer.write_batch(pa.record_batch([pa.array(owner, pa.int64()), pa.array(ids, pa.int64()), pa.array(starts, pa.float64()), pa.array(ends, pa.float64()), column], schema=FEATURES))
    out.close()
    done = 0
    stored = _opened(target)
    for k in range(stored.num_record_batches):
        batch = stored.get_batch(k)
        owner = batch["clip"].to_numpy()
        tensor = batch["log_mel"].storage.flatten().to_numpy().reshape(-1, PATCH * MELS)
        edges = np.flatnonzero(np.diff(owner, prepend=-1))
        part = []
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(owner)]):
            *head, spans, n_frames = rows[done]
            loud = ";".join(f"{x:.4f}-{y:.4f}" for x, y in spans)
            digest = hashlib.sha256(tensor[a:b].tobytes() + loud.encode()).hexdigest()
            part.append((*head, f"{n_frames}x{MELS}:{len(spans)}:{digest[:32]}", n_frames, len(spans), round(sum(y - x for x, y in spans), 6)))
            done += 1
        names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "n_segments", "loud_s")
        text = {3, 6, 7}
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if j in text else pa.float64() if j == 10 else pa.int64()) for j, c in enumerate(zip(*part))], names=list(names))


def encode_media(docs: DataFrame, uri: str | None = None) -> DataFrame:
    """store_media and media_features over docs (doc_id, text)."""
    spark = docs.sparkSession
    return media_features(spark, store_media(docs, uri or shared_dir(spark, "media")))
