"""Media columns: texts' bytes kept losslessly as 8-bit audio, and audio features read back from the stored form.

A payload is stored as a mono WAV file of unsigned 8-bit samples. Features come from the stored bytes: polyphase
resampling by a rational factor, log-mel energies of overlapped frames, spans of activity by an energy threshold with
hysteresis, and two Arrow tensors of fixed shape: mel energies (time spans x bands) and the spans' times (start and end, in
seconds). A cell holds one tensor as an Arrow message, which ``pyarrow.ipc.read_tensor`` reads; Spark has no column type
for it. ``tensor_array`` gives the cells of many rows as one Arrow fixed-shape tensor array.

Defined cases: null and empty texts give one block of padding; long texts are resampled and framed block by block, with
thresholds over the whole; equal texts give equal values; repeated rows give repeated results; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES, PAD, TAIL = 576, 255, 32
STORED_RATE, UP, DOWN, TAPS = 12_000, 2, 3, 16
FRAME, HOP, BANDS, SPANS = 256, 128, 24, 32
FRAMES_AT_ONCE, OUTPUTS_AT_ONCE = 4096, 65_536
RISE_DB, FALL_DB = 1.5, 0.5


def encode_wav(payload: bytes, rate: int = STORED_RATE) -> bytes:
    """A WAV file whose samples are the payload's bytes."""
    odd = b"\0" * (len(payload) % 2)
    chunks = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + odd
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def decode_wav(media: bytes) -> tuple[int, bytes]:
    """(rate, samples) of a mono 8-bit WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif name == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@cache
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed-sinc low-pass, one row of taps for each phase, newest sample last."""
    n = np.arange(up * taps) - (up * taps - 1) / 2
    h = np.sinc(n / max(up, down)) * np.hamming(up * taps)
    return np.ascontiguousarray((h / h.sum() * up).reshape(taps, up).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """x at up/down times its rate: each output is one phase of the filter over the newest ``taps`` samples."""
    phases = _phases(up, down, taps)
    count = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x, np.zeros(1, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    y = np.empty(count, np.float32)
    for at in range(0, count, OUTPUTS_AT_ONCE):
        n = np.arange(at, min(count, at + OUTPUTS_AT_ONCE))
        for phase in range(up):
            own = n[(n * down) % up == phase]
            y[own] = windows[own * down // up] @ phases[phase]
    return y


@cache
def _mel(rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, triangular filters: FFT bins x bands)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, BANDS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    rise, fall = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(y: np.ndarray, rate: int) -> np.ndarray:
    """Frames x bands, frames overlapping by FRAME - HOP; a short signal is one padded frame."""
    window, filters = _mel(rate)
    y = np.concatenate([y, np.zeros(max(0, FRAME - len(y)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    out = np.empty((len(frames), BANDS), np.float32)
    for at in range(0, len(frames), FRAMES_AT_ONCE):
        spectrum = np.fft.rfft(frames[at : at + FRAMES_AT_ONCE] * window, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[at : at + FRAMES_AT_ONCE] = np.log(power @ filters + 1e-6)
    return out


def segments(energy_db: np.ndarray, rise: float = RISE_DB, fall: float = FALL_DB) -> list[tuple[int, int]]:
    """Spans of frames: a span starts where the energy is ``rise`` above the median and lasts while it is ``fall`` above."""
    level = np.median(energy_db)
    known = np.where(energy_db >= level + rise, 1, np.where(energy_db < level + fall, 0, -1))
    last = np.maximum.accumulate(np.where(known >= 0, np.arange(len(known)), -1))
    active = (last >= 0) & (known[last] == 1)
    steps = np.flatnonzero(np.diff(np.concatenate([[False], active, [False]]).astype(np.int8)))
    return list(zip(steps[::2].tolist(), steps[1::2].tolist(), strict=True))


def _message(values: np.ndarray, *names: str) -> bytes:
    """A tensor as an Arrow message."""
    sink = pa.BufferOutputStream()
    pa.ipc.write_tensor(pa.Tensor.from_numpy(np.ascontiguousarray(values), dim_names=list(names)), sink)
    return sink.getvalue().to_pybytes()


def features(media: bytes) -> tuple[bytes, int, list[tuple[float, float]], bytes, bytes]:
    """(payload read back, frames, active spans in seconds, Arrow tensors of SPANS x BANDS energies and SPANS x 2 times)."""
    rate, payload = decode_wav(media)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    own = rate * UP // DOWN
    mel = log_mel(resample(x), own)
    found = segments(10 / np.log(10) * np.log(np.exp(mel).sum(axis=1)))
    cuts = np.arange(SPANS + 1) * len(mel) // SPANS
    sums = np.concatenate([np.zeros((1, BANDS)), np.cumsum(mel, axis=0, dtype=np.float64)])
    low = np.minimum(cuts[:-1], len(mel) - 1)
    high = np.maximum(cuts[1:], low + 1)
    tensor = ((sums[high] - sums[low]) / (high - low)[:, None]).astype("<f4")
    times = np.stack([low * HOP, high * HOP + FRAME - HOP], axis=1) / own
    return payload, len(mel), [(i * HOP / own, (j * HOP + FRAME - HOP) / own) for i, j in found], _message(tensor, "span", "band"), _message(times.astype("<f4"), "span", "edge")


SCHEMA = "key long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, frames int, active array<struct<start:double,end:double>>, tensor binary, times binary"
_SPAN = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int32(), _SPAN, pa.binary(), pa.binary()]


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part, rows = batch.slice(at, 256), []
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                body = (text or "").encode()
                media = encode_wav(body + bytes([PAD]) * (-len(body) % BLOCK_BYTES if body else BLOCK_BYTES))
                payload, frames, active, tensor, times = features(media)
                rows.append((key, len(body), media, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), frames, [{"start": a, "end": b} for a, b in active], tensor, times))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=names)


def audio_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_bytes, the media (WAV), what was read back from it, and its features. Narrow."""
    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(_stored, SCHEMA).withColumnRenamed("key", key)


def tensor_array(cells: list[bytes]) -> pa.Array:
    """Tensors of rows, as collected or read from Parquet, as one Arrow fixed-shape tensor array."""
    tensors = [pa.ipc.read_tensor(pa.py_buffer(c)) for c in cells]
    shape, names = (tensors[0].shape, tensors[0].dim_names) if tensors else ((SPANS, BANDS), ("span", "band"))
    flat = pa.array(np.concatenate([t.to_numpy().ravel() for t in tensors] or [np.zeros(0, np.float32)]))
    storage = pa.FixedSizeListArray.from_arrays(flat, int(np.prod(shape)))
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), list(shape), dim_names=list(names)), storage)


def op4_audio(docs: DataFrame) -> DataFrame:
    feature = F.concat_ws(":", F.col("frames").cast("string"), F.size("active").cast("string"), F.sha2(F.concat("tensor", "times"), 256))
    return audio_columns(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
