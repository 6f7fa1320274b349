"""Media columns: audio bytes in a binary column, and features from them.

``store_media`` keeps each payload losslessly as 8-bit mono samples in a RIFF
WAVE container (a binary column ``media``). ``media_features`` reads the stored
bytes back, resamples them by a polyphase filter, takes overlapped log-mel
filterbanks, and segments by energy with hysteresis. The features are a
fixed-shape tensor (SLOTS x BANDS of float32; ``as_tensor`` gives Arrow's
fixed-shape tensor type) with the time spans of the active segments.

Defined results: a null text is the empty payload, padded like any other to a
positive multiple of 64 bytes; equal texts get equal bytes and features; other
columns pass through, those named like an output are replaced; a null media
value gives null features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import short_batches, table, texts

BLOCK = 64
RATE = 16_000
#: Resampling by UP/DOWN, taps of each phase; frames and hop of the spectrum, in resampled samples.
UP, DOWN, TAPS = 1, 2, 12
FRAME, FRAME_HOP = 256, 128
SLOTS, BANDS = 8, 16
#: Frames handled at once, so that memory doesn't follow the length of a text.
FRAMES_AT_ONCE = 4096


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % BLOCK if payload else BLOCK)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit PCM, one channel: a byte is a sample. An odd payload gets RIFF's pad byte."""
    data = payload + b"\0" * (len(payload) % 2)
    head = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", 4 + len(head) + len(data)) + b"WAVE" + head + data


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Sample rate and samples of an 8-bit mono file; chunks of other kinds are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=8)
def phases(up: int, down: int, taps: int) -> np.ndarray:
    """The windowed-sinc low-pass of the resampler, one row of taps for each phase; every row sums to 1."""
    n = up * taps
    t = (np.arange(n) - (n - 1) / 2) / max(up, down)
    h = np.sinc(t) * np.hamming(n)
    rows = h.reshape(taps, up).T
    return (rows / rows.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase resampling by up/down: only the wanted outputs are computed. Ends count as silence."""
    h = phases(up, down, taps)
    n = -(-len(x) * up // down)
    back = (taps * up - 1) // 2  # the filter's delay
    x = np.concatenate([np.zeros(taps, np.float32), x.astype(np.float32), np.zeros(taps + 1, np.float32)])
    y = np.zeros(n, np.float32)
    for first in range(min(up, n)):
        at = np.arange(first, n, up) * down + back
        base, row = at // up + taps, h[(first * down + back) % up]
        step = slice(first, n, up)
        lo, gap = base[0], down
        for k in range(taps):
            y[step] += row[k] * x[lo - k : lo - k + gap * (len(base) - 1) + 1 : gap]
    return y


@lru_cache(maxsize=8)
def mel_bank(rate: int, frame: int, bands: int) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale (2595 log10(1 + f/700))."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1) * rate / frame
    up = (f[:, None] - edges[:-2]) / np.maximum(edges[1:-1] - edges[:-2], 1e-9)
    down = (edges[2:] - f[:, None]) / np.maximum(edges[2:] - edges[1:-1], 1e-9)
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def segments(energy: np.ndarray, on: float, off: float) -> np.ndarray:
    """Runs of frames at or above ``off`` that reach ``on``: rows of first and one past the last frame."""
    edge = np.diff(np.concatenate([[0], energy >= off, [0]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return np.zeros((0, 2), np.int64)
    reached = np.logical_or.reduceat(np.append(energy >= on, False), np.column_stack([first, last]).ravel())[::2]
    return np.column_stack([first, last])[reached]


def features(rate: int, samples: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """The tensor (SLOTS, BANDS) of mean log-mel energies in equal time slots, and the active spans in seconds."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    n_out = -(-len(x) * UP // DOWN)
    n_frames = max(1, -(-max(0, n_out - FRAME) // FRAME_HOP) + 1)
    bank, window = mel_bank(rate * UP // DOWN, FRAME, BANDS), np.hanning(FRAME).astype(np.float32)
    slot = np.minimum(SLOTS - 1, np.arange(n_frames) * SLOTS // n_frames)
    sums, energy = np.zeros((SLOTS, BANDS)), np.empty(n_frames, np.float32)
    y = resample(x)
    y = np.concatenate([y, np.zeros((n_frames - 1) * FRAME_HOP + FRAME - len(y), np.float32)]) if len(y) < (n_frames - 1) * FRAME_HOP + FRAME else y
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::FRAME_HOP]
    for i in range(0, n_frames, FRAMES_AT_ONCE):
        own = frames[i : min(i + FRAMES_AT_ONCE, n_frames)]
        spectrum = np.fft.rfft(own * window, axis=1)
        logmel = np.log10((spectrum.real**2 + spectrum.imag**2) @ bank + 1e-6)
        energy[i : i + len(own)] = np.log10((own * own).mean(axis=1) + 1e-6)
        s = slot[i : i + len(own)]
        first = np.flatnonzero(np.diff(s, prepend=-1))
        sums[s[first]] += np.add.reduceat(logmel.astype(np.float64), first, axis=0)
    tensor = (sums / np.maximum(1, np.bincount(slot, minlength=SLOTS))[:, None]).astype(np.float32)
    level, spread = float(energy.mean()), float(energy.std())
    hop = FRAME_HOP * DOWN / UP / rate
    spans = [(round(a * hop, 4), round(b * hop, 4)) for a, b in segments(energy, level + 0.5 * spread, level - 0.25 * spread).tolist()]
    return tensor, spans


def as_tensor(flat: np.ndarray) -> pa.Array:
    """Rows of SLOTS*BANDS floats as an array of Arrow's fixed-shape tensor type."""
    kind = pa.fixed_shape_tensor(pa.float32(), (SLOTS, BANDS))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel(), pa.float32()), SLOTS * BANDS))


SPANS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))


def pack_tensor(tensor: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """An Arrow stream of one row: the fixed-shape tensor and its time spans."""
    own = pa.array([[{"start_s": a, "end_s": b} for a, b in spans]], SPANS)
    batch = pa.RecordBatch.from_arrays([as_tensor(tensor.astype(np.float32)), own], names=["tensor", "spans"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_tensor(stored: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """The tensor (SLOTS, BANDS) and the spans of a stored stream."""
    batch = pa.ipc.open_stream(stored).read_next_batch()
    tensor = batch.column(0)
    if tensor.type != pa.fixed_shape_tensor(pa.float32(), (SLOTS, BANDS)):
        raise ValueError(f"not a tensor of {SLOTS} x {BANDS} floats: {tensor.type}")
    return tensor.to_numpy_ndarray()[0], [(s["start_s"], s["end_s"]) for s in batch.column(1)[0].as_py()]


def _with(docs: DataFrame, fields: list[T.StructField], make) -> DataFrame:
    """Columns of docs, those of ``fields`` made anew by make(batch)."""
    names = [f.name for f in fields]
    out = T.StructType([f for f in docs.schema.fields if f.name not in names] + fields)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keep = [n for n in b.schema.names if n not in names]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in keep] + make(b), names=keep + names)

    return docs.mapInArrow(run, out)


def store_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``media`` (WAVE bytes of the padded text) and ``n_bytes`` (of the text alone)."""
    short_batches(docs.sparkSession)

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        own = texts(b, text)
        return [pa.array([to_wav(padded(t)) for t in own], pa.binary()), pa.array([len(t) for t in own], pa.int64())]

    return _with(docs, [T.StructField("media", T.BinaryType()), T.StructField("n_bytes", T.LongType())], make)


def media_features(docs: DataFrame) -> DataFrame:
    """Read ``media`` back; add digests, ``tensor`` (an Arrow stream with the fixed-shape tensor and its time spans), ``spans`` and ``feature``, a digest of what is read back from ``tensor``."""
    fields = [
        T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("tensor", T.BinaryType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))), T.StructField("feature", T.StringType()),
    ]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), SPANS, pa.string()]

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * len(kinds)
        rate, payload = from_wav(media)
        tensor, spans = features(rate, payload)
        stored = pack_tensor(np.round(tensor.astype(np.float64), 3), spans)
        tensor, spans = unpack_tensor(stored)
        flat = tensor.ravel().astype(np.float64)
        said = hashlib.sha256(np.round(flat, 2).tobytes() + repr(spans).encode()).hexdigest()[:16]
        feature = f"logmel{SLOTS}x{BANDS}:{flat.mean():.2f}:segments={len(spans)}:{said}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), stored, [{"start_s": a, "end_s": b} for a, b in spans], feature

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        rows = [one(m) for m in b.column(b.schema.get_field_index("media")).to_pylist()]
        return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

    return _with(docs, fields, make)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as stored samples, read back, with digests and features."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = store_media(docs).select("doc_id", "n_bytes", "media")
    return media_features(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensor", "spans")
