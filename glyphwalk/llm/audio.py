"""Audio columns: 8-bit PCM in WAV form, polyphase resampling, log-mel features, energy segments.

``encode`` stores bytes as unsigned 8-bit samples, one channel, and ``decode`` gives them back
exactly. ``features`` resamples by 3/4 with a polyphase filter (each output sample is computed by one
of three phases of the filter), takes overlapped windows, and gives log-mel energies in tensors of one
fixed shape with the time span of each; ``segments`` finds active spans by two energy thresholds.
``to_arrow`` stores them as an Arrow stream whose tensor column has the fixed-shape tensor type,
with the spans beside it; the digest is made from what ``from_arrow`` reads back.

Long signals are transformed in blocks of ``BLOCK`` frames, so memory grows with a text's own bytes
only. The result depends on the text alone: every text is computed by itself, in the same blocks. Null
is the empty text (64 zero bytes); repeated rows repeat; an empty table gives an empty result. Columns
other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import json
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE, UP, DOWN = 16_000, 3, 4
FRAME, HOP, MELS = 256, 128, 16
SHAPE = (16, MELS)  # frames and bands of one tensor
BLOCK = 4096
#: Hysteresis in standard deviations of log energy: a span starts above HIGH and ends below LOW.
HIGH, LOW = 0.5, -0.5


def encode(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def decode(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


@lru_cache(maxsize=8)
def _phases(up: int, down: int, taps: int = 4) -> tuple[np.ndarray, int]:
    """Filter phases (row p filters the inputs that meet phase p) and the index of the filter's centre."""
    n = taps * 2 * max(up, down) + 1
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    h *= up / h.sum()
    width = -(-n // up)
    padded = np.zeros(width * up)
    padded[:n] = h
    return padded.reshape(width, up).T.astype(np.float32), (n - 1) // 2


def resample(signal: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Rational resampling: output i is the filter's centre at i * down of the signal spread by ``up``.

    With u = i * down + centre, phase u % up meets the inputs that end at u // up.
    """
    phases, centre = _phases(up, down)
    width = phases.shape[1]
    x = np.concatenate([np.zeros(width - 1, np.float32), signal.astype(np.float32), np.zeros(width, np.float32)])
    n = -(-len(signal) * up // down)
    out = np.empty(n, np.float32)
    view = np.lib.stride_tricks.sliding_window_view(x, width)
    for first in range(min(up, n)):
        u = first * down + centre
        rows = view[u // up :: down]
        count = -(-(n - first) // up)
        for b in range(0, count, 1 << 16):
            e = min(count, b + (1 << 16))
            out[first + b * up : first + (e - 1) * up + 1 : up] = rows[b:e] @ phases[u % up][::-1]
    return out


@lru_cache(maxsize=8)
def _mel(rate: int, frame: int, mels: int) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hz = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(frame, 1 / rate)
    up = (bins[:, None] - hz[:-2]) / (hz[1:-1] - hz[:-2])
    down = (hz[2:] - bins[:, None]) / (hz[2:] - hz[1:-1])
    return np.clip(np.minimum(up, down), 0, None).astype(np.float32)


def log_mel(signal: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies and log energy of overlapped windows; the last window is padded."""
    n = max(1, -(-(len(signal) - FRAME) // HOP) + 1)
    x = np.zeros((n - 1) * HOP + FRAME, np.float32)
    x[: len(signal)] = signal
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, bank = np.hanning(FRAME).astype(np.float32), _mel(rate, FRAME, MELS)
    bands, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for b in range(0, n, BLOCK):
        part = frames[b : b + BLOCK] * window
        power = np.abs(np.fft.rfft(part, axis=1)).astype(np.float32) ** 2
        bands[b : b + BLOCK] = np.log(power @ bank + 1e-6)
        energy[b : b + BLOCK] = np.log((part * part).sum(1) + 1e-6)
    return bands, energy


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> list[tuple[int, int]]:
    """Spans of frames: begun by a frame above ``high``, held while frames stay above ``low``."""
    level = (energy - energy.mean()) / max(float(energy.std()), 1e-6)
    held = np.flatnonzero(np.diff(np.concatenate([[0], (level > low).astype(np.int8), [0]])))
    loud = np.concatenate([[0], np.cumsum(level > high)])
    return [(int(a), int(b)) for a, b in held.reshape(-1, 2) if loud[b] > loud[a]]


def features(payload: bytes, rate: int = RATE) -> dict:
    """Tensors of shape SHAPE (the last one padded), their spans in seconds, and active spans."""
    signal = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    out_rate = rate * UP // DOWN
    bands, energy = log_mel(resample(signal), out_rate)
    count = -(-len(bands) // SHAPE[0])
    tensor = np.full((count * SHAPE[0], MELS), np.log(np.float32(1e-6)), np.float32)
    tensor[: len(bands)] = bands
    spans = [(k * SHAPE[0] * HOP / out_rate, min((k + 1) * SHAPE[0], len(bands)) * HOP / out_rate) for k in range(count)]
    active = [(a * HOP / out_rate, ((b - 1) * HOP + FRAME) / out_rate) for a, b in segments(energy)]
    return {"tensors": tensor.reshape(count, *SHAPE), "spans": spans, "active": active, "frames": len(bands)}


def tensor_array(tensors: np.ndarray) -> pa.Array:
    """Arrow fixed-shape tensors over one contiguous buffer."""
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors))


def to_arrow(found: dict) -> bytes:
    """Features as an Arrow stream: fixed-shape tensors and their spans; the active spans are metadata."""
    batch = pa.RecordBatch.from_arrays(
        [tensor_array(found["tensors"]), pa.array([a for a, _ in found["spans"]], pa.float64()), pa.array([b for _, b in found["spans"]], pa.float64())], ["tensor", "start_s", "end_s"]
    )
    batch = batch.replace_schema_metadata({"active": json.dumps(found["active"]), "frames": str(found["frames"])})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_arrow(stored: bytes) -> dict:
    """What ``to_arrow`` was given, from the stream."""
    table = pa.ipc.open_stream(stored).read_all()
    kind, meta = table.schema.field("tensor").type, table.schema.metadata
    if not isinstance(kind, pa.FixedShapeTensorType):
        raise TypeError(f"no fixed-shape tensors but {kind}")
    tensors = table["tensor"].combine_chunks()
    tensors = tensors.chunk(0) if isinstance(tensors, pa.ChunkedArray) else tensors
    return {
        "tensors": tensors.to_numpy_ndarray(), "spans": list(zip(table["start_s"].to_pylist(), table["end_s"].to_pylist(), strict=True)),
        "active": [tuple(x) for x in json.loads(meta[b"active"])], "frames": int(meta[b"frames"]), "shape": tuple(kind.shape),
    }


def describe(found: dict) -> str:
    """Digest of the features: counts, shape, end of the last span, active time and the mean of every band, rounded."""
    bands = found["tensors"].reshape(-1, MELS)[: found["frames"]].mean(axis=0, dtype=np.float64)
    active = sum(b - a for a, b in found["active"])
    shape = "x".join(map(str, found["tensors"].shape[1:]))
    return (
        f"frames={found['frames']};tensors={len(found['spans'])};shape={shape};end={found['spans'][-1][1]:.3f};segments={len(found['active'])};active={active:.3f};mel="
        + ",".join(f"{x:.2f}" for x in bands)
    )


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the text, padded with zero bytes to a positive multiple of 64, and its own length."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media, tensors) of each text: the WAV file and the Arrow stream of its features."""
    kind = dict(docs.dtypes)[id_col]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for doc, text in zip(part.column(0), part.column(1), strict=True):
                stored = encode(payload_of(text.as_py())[0])
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], part.schema.field(0).type), pa.array([stored]), pa.array([to_arrow(features(decode(stored)))])], [id_col, "media", "tensors"])

    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, media binary, tensors binary")


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: sizes and hashes of payload and stored form, a digest of the features, and these as an Arrow stream."""
    kind = dict(docs.dtypes)[id_col]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for text in part.column(1):
                payload, n = payload_of(text.as_py())
                stored = encode(payload)
                back = decode(stored)
                tensors = to_arrow(features(back))
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(from_arrow(tensors)), tensors))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensors"],
            )

    return docs.select(id_col, F.col(text_col).alias("__text")).mapInArrow(
        run,
        f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensors binary",
    )
